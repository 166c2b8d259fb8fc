"""Column expressions; nothing in here touches a DataFrame."""
