"""Part of fernspan; see README.md."""
