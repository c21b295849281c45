"""Column builders for text: names, labels, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(x: Column | str) -> Column:
    """Lower case, outer white space of any kind removed; null stays null."""
    return F.lower(F.regexp_replace(c(x), r"^\s+|\s+$", ""))


def pad_empty(x: Column | str, pad: str = "<PAD>") -> Column:
    """Embedding services refuse empty input."""
    return F.when(c(x) == "", pad).otherwise(c(x))


def author_label(author: Column | str, source: Column | str) -> Column:
    """``{author} of {source}``, or ``Journalist of {source}`` where no author is known."""
    return F.concat(F.coalesce(c(author), F.lit("Journalist")), F.lit(" of "), c(source))


def kb_description_text(label: Column | str, description: Column | str) -> Column:
    return F.concat_ws(" ", F.lower(c(label)), c(description))


def augmented_entity(label: Column | str, description: Column | str, aliases: Column | str, lower: bool = True) -> Column:
    """``{label} ({description}) | Aliases: a, b``; the alias part only where there are aliases."""
    text = F.concat(c(label), F.lit(" ("), F.coalesce(c(description), F.lit("")), F.lit(")"))
    text = F.when(F.coalesce(F.size(c(aliases)), F.lit(0)) > 0, F.concat(text, F.lit(" | Aliases: "), F.array_join(c(aliases), ", "))).otherwise(text)
    return F.lower(text) if lower else text


def user_prompt(delimiter: str, **fields: Column | str) -> Column:
    """Named fields between delimiters, in the given order; null fields are empty."""
    parts = [F.concat(F.lit(f"{name}: {delimiter}"), F.coalesce(c(v).cast("string"), F.lit("")), F.lit(delimiter)) for name, v in fields.items()]
    return F.concat_ws("\n", *parts)


def instruct(x: Column | str, prefix: str | None) -> Column:
    """The prefix of the model at hand, and of no other."""
    return F.concat(F.lit(prefix), c(x)) if prefix else c(x)


def strip_fences(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(x), r"```(?:json|html)?", ""))


def q_id(x: Column | str) -> Column:
    return F.concat(F.lit("Q"), c(x).cast("string"))


def order_key(*numbers: Column | str) -> Column:
    """A text that orders and tells apart rows as their whole numbers do: fixed-width digits of each, shifted to be positive; null if one is null."""
    shift = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.concat(*[F.lpad((c(n).cast("decimal(20,0)") + shift).cast("decimal(20,0)").cast("string"), 20, "0") for n in numbers])


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part.cast("double") / whole.cast("double"), digits))


def contains_all(x: Column | str, *parts: str) -> Column:
    return reduce(lambda a, b: a & b, [F.lower(c(x)).contains(p.lower()) for p in parts])


def contains_any(x: Column | str, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c(x)).contains(p.lower()) for p in parts])


def is_true(x: Column | str) -> Column:
    """A flag given as boolean or as the words True and False; anything else is null."""
    s = F.lower(F.trim(c(x).cast("string")))
    return F.when(s == "true", True).when(s == "false", False)


def country_or_null(code: Column | str) -> Column:
    """Upper-cased country code; the word None stands for no country."""
    return F.nullif(F.upper(F.trim(c(code))), F.lit("NONE"))


# Three-letter codes of countries, and other names of them.
ISO3 = {
    "algeria": "DZA", "argentina": "ARG", "austria": "AUT", "belgium": "BEL", "brazil": "BRA", "bulgaria": "BGR", "canada": "CAN", "chile": "CHL", "china": "CHN", "colombia": "COL", "croatia": "HRV", "czechia": "CZE", "denmark": "DNK", "egypt": "EGY",
    "estonia": "EST", "ethiopia": "ETH", "finland": "FIN", "france": "FRA", "germany": "DEU", "greece": "GRC", "hungary": "HUN", "india": "IND", "indonesia": "IDN", "iran": "IRN", "iraq": "IRQ", "ireland": "IRL", "israel": "ISR", "italy": "ITA", "japan": "JPN",
    "jordan": "JOR", "kenya": "KEN", "latvia": "LVA", "lithuania": "LTU", "mexico": "MEX", "moldova": "MDA", "morocco": "MAR", "mozambique": "MOZ", "netherlands": "NLD", "norway": "NOR", "peru": "PER", "poland": "POL", "portugal": "PRT", "romania": "ROU",
    "russia": "RUS", "saudi arabia": "SAU", "serbia": "SRB", "slovakia": "SVK", "slovenia": "SVN", "south africa": "ZAF", "south korea": "KOR", "spain": "ESP", "sweden": "SWE", "switzerland": "CHE", "syria": "SYR", "turkey": "TUR", "ukraine": "UKR",
    "united kingdom": "GBR", "united states": "USA", "venezuela": "VEN", "vietnam": "VNM"}
COUNTRY_ALIASES = {
    "america": "USA", "united states of america": "USA", "usa": "USA", "us": "USA", "u.s.": "USA", "great britain": "GBR", "britain": "GBR", "england": "GBR", "uk": "GBR", "russian federation": "RUS", "czech republic": "CZE", "holland": "NLD", "the netherlands": "NLD",
    "türkiye": "TUR", "korea": "KOR", "deutschland": "DEU", "people's republic of china": "CHN"}


def country_code(x: Column | str) -> Column:
    """The three-letter code a typed country means: by name, other name or code, else by the one name within a single edit; null if none or several fit."""
    s = F.lower(F.trim(c(x)))
    known = {**ISO3, **COUNTRY_ALIASES, **{v.lower(): v for v in ISO3.values()}}
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in ISO3.items() if len(n) > 3])
    near = F.array_distinct(F.transform(F.filter(names, lambda e: F.levenshtein(e["n"], s) <= 1), lambda e: e["v"]))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(y) for pair in known.items() for y in pair]), s), F.when((F.length(s) > 3) & (F.size(near) == 1), F.element_at(near, 1)))


def collate(tokens: Column | str, length: int, pad: str = "<pad>") -> list[Column]:
    """``tokens`` cut or padded to ``length``, and ``mask`` with 1 for real tokens and 0 for padding; null gives padding only."""
    t = F.coalesce(F.slice(c(tokens), 1, length), F.array().cast("array<string>"))
    gap = F.lit(length) - F.size(t)
    return [F.concat(t, F.array_repeat(F.lit(pad), gap)).alias("tokens"), F.concat(F.transform(t, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("mask")]


def any_timestamp(x: Column | str) -> Column:
    """A timestamp given as ISO text, as epoch seconds or as epoch milliseconds; null otherwise."""
    s = F.trim(c(x))
    digits = s.rlike(r"^\d{9,14}$")
    n = F.when(digits, s).try_cast("bigint")
    epoch = F.when(n >= 100_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    return F.when(digits, epoch).otherwise(F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in ("dd.MM.yyyy HH:mm", "dd.MM.yyyy", "MM/dd/yyyy HH:mm", "yyyy/MM/dd HH:mm:ss", "d MMM yyyy HH:mm", "d MMMM yyyy, HH:mm", "MMM d, yyyy")]))
