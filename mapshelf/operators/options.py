"""Dataset options: one ``map<string,string>`` whatever form they were given in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a quoted token, or a bare token up to the next blank.
TOKEN = r"'[^']*'|\"[^\"]*\"|[^\"'\s]\S*"


def _last_wins(entries: Column) -> Column:
    """Array of key-value pairs to a map; the last value of a repeated key stays."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
        F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def _entry(token: Column) -> Column:
    """``key:value`` splits at the first colon; ``-flag`` means true."""
    colon = F.locate(":", token)
    flag = F.startswith(token, F.lit("-"))
    key = F.when(flag, F.regexp_replace(token, "^-", "")).when(
        colon > 0, F.substr(token, F.lit(1), colon - 1))
    value = F.when(flag, F.lit("true")).when(colon > 0, F.substr(token, colon + 1))
    return F.struct(key.alias("key"), value.alias("value"))


def options_from_list(tokens: Column) -> Column:
    entries = F.filter(F.transform(tokens, _entry), lambda e: e["key"].isNotNull())
    return F.when(tokens.isNotNull(), _last_wins(entries))


def options_from_text(text: Column) -> Column:
    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)),
        lambda t: F.regexp_replace(t, "^['\"](.*)['\"]$", "$1"))
    return options_from_list(tokens)


def normalize_options(text: Column | None = None, items: Column | None = None,
                      mapping: Column | None = None) -> Column:
    """First form present of: command line text, list of ``key:value``, map."""
    forms = []
    if text is not None:
        forms.append(options_from_text(text))
    if items is not None:
        forms.append(options_from_list(items))
    if mapping is not None:
        forms.append(mapping.cast("map<string,string>"))
    return F.coalesce(*forms)


def merge_options(run: Column, dataset: Column) -> Column:
    """Run options overlaid by dataset options."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    run, dataset = F.coalesce(run, empty), F.coalesce(dataset, empty)
    kept = F.map_filter(run, lambda k, v: ~F.map_contains_key(dataset, k))
    return F.map_concat(kept, dataset)


def options_text(options: Column) -> Column:
    """``key=value`` pairs in key order, one per line."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), "\n")
