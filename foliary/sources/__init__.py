"""Sources: packages of parts, images, page files."""
