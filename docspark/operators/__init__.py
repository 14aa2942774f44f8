"""Operators on whole collections: mutations, structure statistics, layout advice."""
