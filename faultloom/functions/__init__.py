"""Column functions: rules, text helpers and their SQL registrations."""
