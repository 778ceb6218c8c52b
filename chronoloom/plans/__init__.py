"""Parameters and whole reports: from relations to result frames."""
