"""DataFrame-in, DataFrame-out operators. Every grouped operator takes ``by`` columns."""
