"""Events gathered into situations: what an event says, how well it fits a situation, and how situations live, merge and end."""
