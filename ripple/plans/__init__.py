"""Plans: captions, labels, reports, and the engine that wires operators into whole queries."""
