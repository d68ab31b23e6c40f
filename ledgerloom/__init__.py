"""ledgerloom: document and ledger analytics expressed as Spark DataFrame transforms."""
