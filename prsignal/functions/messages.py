"""Text of a suggestion, picked from fixed phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prsignal.functions.text import bucket_of

# Greetings and phrases.  "{name}" is the name the commenter goes by.
GREETINGS = (
    "Henlo friend. 🦄",
    "Hrmmm...",
    "Hi, just checking in.",
    "Hi...🦄 So I read your PR...",
    "Me again, just one more nit...🌈",
    "Nit... but...",
)
PHRASES = (
    "Something looks weird here. Are you sure about this? 🌈",
    "Woah... this old bit again... 🦄",
    "So... are you sure about this 🐼 pandas?",
    "Meeps... this looks strange...",
    "Meeps Meeps... this looks weird...",
    "Hrmm.. this looks funny...",
    "{name} is confused... 🐼",
    "{name} is confused... 🌈🐼",
    "Are you sure about this?⚡",
    "Wondering why this is here...? 🌈🐼",
    "So maybe take a look here? ⚡🐼",
)


def suggestion_message(key: Column, name: str = "Reviewer") -> Column:
    """A greeting and a phrase, picked by hash of ``key`` so that reruns agree."""
    greetings = F.array(*(F.lit(g) for g in GREETINGS))
    phrases = F.array(*(F.lit(p.format(name=name)) for p in PHRASES))
    greeting = F.get(greetings, bucket_of(key, len(GREETINGS)).cast("int"))
    phrase = F.get(phrases, bucket_of(F.concat(key, F.lit("#")), len(PHRASES)).cast("int"))
    return F.concat_ws(" ", greeting, phrase)
