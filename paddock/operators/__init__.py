"""DataFrame operators, parameterised by column names."""
