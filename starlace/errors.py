"""Errors of the pattern language and the planner."""


class PatternError(ValueError):
    """Any fault of a pattern."""


class PatternSyntaxError(PatternError):
    """The text isn't a pattern."""


class PatternGraphError(PatternError):
    """Vertices, arcs or edges don't fit together."""


class PatternTypeError(PatternError):
    """A constraint has the wrong type, or names a vertex that isn't declared."""


class PlanError(ValueError):
    """The given roots can't evaluate the pattern."""


class GraphDataError(ValueError):
    """The data graph breaks its own rules."""
