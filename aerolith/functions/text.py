from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(code: Column) -> Column:
    return F.upper(F.trim(code))


# Fixed value: characters after which a new word starts. An apostrophe is none of them.
WORD_BREAKS = r"""\s!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>"""


def initcap_words(text: Column) -> Column:
    """initcap that starts a new word after punctuation too.

    Spark's initcap only breaks at spaces: ``dallas-fort worth`` keeps a small f.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD_BREAKS}]+|[^{WORD_BREAKS}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def normalise_name(name: Column, patterns: dict[str, str]) -> Column:
    """First substring (any case) that occurs decides the name; else initcap."""
    result = None
    for part, replacement in patterns.items():
        test, value = name.ilike(f"%{part}%"), F.lit(replacement)
        result = F.when(test, value) if result is None else result.when(test, value)
    return initcap_words(name) if result is None else result.otherwise(initcap_words(name))


def place_label(city: Column, state: Column, code: Column | None = None,
                missing_state: str | None = None) -> Column:
    """``City, ST`` or ``City, ST (CODE)``; null when a part is null.

    ``missing_state`` stands in for a null state, so only that part may be absent.
    """
    if missing_state is not None:
        state = F.coalesce(state, F.lit(missing_state))
    parts = [city, F.lit(", "), state]
    if code is not None:
        parts += [F.lit(" ("), code, F.lit(")")]
    return F.concat(*parts)
