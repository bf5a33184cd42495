"""The ordered fold of notes into facts."""
