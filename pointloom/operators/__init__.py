"""DataFrame operators over point sets, surfaces and curves."""
