"""From SQL text to DataFrames: lexer, parser, syntax tree, lowering."""
