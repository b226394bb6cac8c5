"""Where lines come from: tables, files, directories, legacy encodings, HTML and EPUB."""
