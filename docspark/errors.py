"""Errors that callers can tell apart by class or by ``code``."""


class DocsparkError(Exception):
    code = "ERROR"


class SyntaxProblem(DocsparkError):
    code = "SYNTAX"


class UnsupportedSyntax(SyntaxProblem):
    code = "UNSUPPORTED"


class UnknownFunction(SyntaxProblem):
    code = "UNKNOWN_FUNCTION"


class AmbiguousField(DocsparkError):
    code = "AMBIGUOUS_FIELD"


class InvalidDocument(DocsparkError, TypeError):
    code = "INVALID_DOCUMENT"


class InvalidOption(DocsparkError, TypeError):
    code = "INVALID_OPTION"


class ReadOnly(DocsparkError):
    code = "READ_ONLY"


class IntegrityError(DocsparkError):
    code = "INTEGRITY"


class Closed(DocsparkError):
    code = "CLOSED"


class Aborted(DocsparkError):
    code = "ABORTED"


class TimedOut(DocsparkError):
    code = "TIMEOUT"
