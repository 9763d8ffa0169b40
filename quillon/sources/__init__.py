"""Sources: workbooks as tables of cells, printed pages as tables of tokens, statements."""
