"""Named query plans; ``load()`` fills the registry."""

from importlib import import_module

AREAS = ["sources", "catalogue", "search", "pairs", "recommend", "content", "learned", "lyrics_charts", "listeners",
         "evaluation", "frames", "streams", "classic"]


def load() -> None:
    for area in AREAS:
        try:
            import_module(f"tonearm.plans.{area}")
        except ModuleNotFoundError as error:
            if error.name != f"tonearm.plans.{area}":
                raise
