"""Change streams into indexed tables."""
