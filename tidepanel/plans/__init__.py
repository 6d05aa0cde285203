"""How queries are set up: sessions whose settings fit the input."""
