"""Sources: document files, inline documents, key providers."""
