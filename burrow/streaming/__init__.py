"""Archives that arrive one after the other, as a stream of entries."""
