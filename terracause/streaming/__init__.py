"""There are no streams in this domain: panels are batches of months. Nothing is built here."""
