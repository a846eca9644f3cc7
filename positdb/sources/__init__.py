"""Where posits come from and go to: the store, shredding of tables, the integrity ledger."""
