"""Reading listing files and captures, writing exports and batch documents."""
