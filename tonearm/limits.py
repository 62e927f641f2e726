"""Bounds of requests: a value outside is an error, never silently changed."""

MAX_LIST = 50  # fixed value: longest list a recommender returns
MAX_SEARCH = 200  # fixed value: longest result of a fuzzy search
MAX_PAGE = 100  # fixed value: largest page


def within(value: int, most: int, name: str) -> int:
    """``value`` if it lies in 1..most."""
    if not 1 <= int(value) <= most:
        raise ValueError(f"{name} must be from 1 to {most}, not {value}")
    return int(value)
