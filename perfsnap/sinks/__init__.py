"""Writers of documents, sections and reports."""
