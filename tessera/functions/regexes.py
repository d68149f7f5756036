"""Pattern layer: Python-style regular expressions, with Unicode classes, for the JVM's engine."""

#: White space as Python sees it: the JVM's Unicode class lacks the four separators U+001C to U+001F.
SPACE = r"[\s\x1C-\x1F]"
NOT_SPACE = r"[^\s\x1C-\x1F]"


def java(pattern: str) -> str:
    """Unicode-aware classes, and case-insensitivity that knows more than ASCII."""
    return "(?U)" + pattern.replace("(?i)", "(?iu)")


def char_class(signs: str) -> str:
    """A class of just these characters."""
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in dict.fromkeys(signs)) + "]"
