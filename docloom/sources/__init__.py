"""Sources: files and tables read into blocks."""
