"""Where rows come from: memory, files, JSON, databases, and readers of one's own."""
