"""Column expressions over plain text: scores of text pairs, tokens, fences, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens; an empty text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def equals_score(output: Column, reference: Column) -> Column:
    return output.eqNullSafe(reference).cast("double")


def contains_score(output: Column, substring: Column, case_sensitive: bool = True) -> Column:
    if not case_sensitive:
        output, substring = F.lower(output), F.lower(substring)
    return F.contains(output, substring).cast("double")


def regex_score(output: Column, pattern: str) -> Column:
    """1.0 if the pattern is found anywhere; letters and word edges are Unicode ones."""
    return output.rlike(f"(?U){pattern}").cast("double")


#: A key with its colon, another string, what is between strings, a quote that is never closed.
_JSON_PARTS = r'("(?:[^"\\]|\\.)*"\s*:)|("(?:[^"\\]|\\.)*")|[^"]+|"'


_END = "end of the text in question"


def is_json(text: Column) -> Column:
    """Is the text one JSON value? Keys may repeat, whatever the session's setting for variants says."""
    parts = F.regexp_extract_all(text, F.lit(_JSON_PARTS), F.lit(0))
    # Every key gets its place, which makes it unique and leaves all other syntax to the parser.
    unique = F.transform(parts, lambda part, i: F.when(part.rlike(r'(?s)^".*"\s*:$'), F.concat(F.lit('"'), i.cast("string"), F.lit(" "), F.substring(part, F.lit(2), F.length(part)))).otherwise(part))

    def parsed(value: Column) -> Column:
        # The parser stops after the first value: as the first of two list items the text has to be one value and all of it.
        items = F.try_parse_json(F.concat(F.lit("["), value, F.lit(f', "{_END}"]')))
        return F.coalesce(F.try_variant_get(items, "$[1]", "string") == _END, F.lit(False))

    return F.coalesce(F.when(parsed(text), True).otherwise(parsed(F.array_join(unique, ""))), F.lit(False))


def last_of_each(data: Column) -> Column:
    """A parsed JSON object as a map in which the last value of a repeated key stays."""
    keys = F.map_keys(data)
    last = F.filter(F.map_entries(data), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(last)


def json_score(text: Column) -> Column:
    """1.0 if the text is one JSON value; a bare ``null`` counts, an empty text does not."""
    return is_json(text).cast("double")


#: Distances up to this are sought first; the band then doubles until it holds the distance.
NARROWEST = 64
#: Where the shorter text has so many characters at most, the whole table costs no more than bands.
SHORT = 256


def levenshtein_distance(output: Column, reference: Column) -> Column:
    """Edit distance, -1 for a null side; equal texts are not walked through.

    Sought in bands of 64, 128, 256, ... around the diagonal, so the cost follows the distance and not the square of the lengths.
    Where one text is short, or far shorter than the other, the whole table is small.
    """
    longest, apart = F.greatest(F.length(output), F.length(reference)), F.abs(F.length(output) - F.length(reference))
    shortest = longest - apart
    doublings = lambda size: F.greatest(F.ceil(F.log2(size / F.lit(NARROWEST))), F.lit(0)).cast("int")
    # The lengths' difference is the least the distance can be, the longer length the most.
    steps = F.sequence(doublings(F.greatest(apart, F.lit(1))), doublings(longest))
    in_band = lambda k: F.call_function("levenshtein", output, reference, F.call_function("shiftleft", F.lit(NARROWEST), k))
    banded = F.aggregate(steps, F.lit(-1), lambda found, k: F.when(found >= 0, found).otherwise(in_band(k)))
    distance = F.when(output == reference, 0).when((shortest <= SHORT) | (shortest <= 2 * apart), F.levenshtein(output, reference)).otherwise(banded)
    return F.coalesce(distance, F.lit(-1))


def levenshtein_score(output: Column, reference: Column) -> Column:
    """(longer length - distance) / longer length; 1.0 for two empty texts, 0.0 for a null."""
    return score_of_distance(output, reference, levenshtein_distance(output, reference))


def score_of_distance(output: Column, reference: Column, distance: Column) -> Column:
    """The ratio of a distance that is already known; -1 stands for a null side."""
    longest = F.greatest(F.length(output), F.length(reference))
    known = F.when(longest == 0, 1.0).otherwise((longest - distance) / longest)
    return F.when(output.isNull() | reference.isNull(), 0.0).otherwise(known)


def strip_fences(text: Column) -> Column:
    """Inside of a Markdown fence, or the trimmed text where there is none."""
    fenced = r"(?is)```(?:sql|json)\s*(.*?)(?:```|$)"
    plain = r"(?s)^\s*```\w*\s*(.*?)\s*(?:```\s*)?$"
    inner = (
        F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1))
        .when(text.rlike(r"^\s*```"), F.regexp_extract(text, plain, 1))
        .otherwise(text)
    )
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a fixed template in one pass.

    The template is cut into pieces beforehand, so braces in filled text stay text.
    An unknown place is left as it is.
    """
    pieces = re.split(r"(\{\w+\})", template)
    return F.concat(*[fields[p[1:-1]] if p[1:-1] in fields and p[:1] == "{" else F.lit(p) for p in pieces if p])


def fill_from(template: Column, fields: dict[str, Column]) -> Column:
    """Like ``fill`` for a template that is itself a column."""
    pieces = F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), 0)
    values = F.map_from_arrays(F.array(*[F.lit(f"{{{k}}}") for k in fields]), F.array(*fields.values()))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(values, p), p)), "")


def placeholders(template: Column) -> Column:
    """Names of the places of a template."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1))
