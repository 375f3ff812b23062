"""Column functions on text: placeholders, aspect gate, addresses, ids, URLs, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aspects in order, and the words that gate them.
ASPECT_KEYWORDS = {
    "location": ["location", "located", "locate", "metro", "subway", "station", "walk", "walking", "centre", "center", "central", "downtown", "distance", "nearby", "close to", "far from", "transport", "tram", "bus", "airport", "neighbourhood", "neighborhood", "grand place", "city center", "city centre"],
    "cleanliness": ["clean", "dirty", "dust", "dusty", "hygien", "spotless", "stain", "smell", "smelly", "tidy", "mold", "mould", "filthy", "unclean", "immaculate", "grubby"],
    "breakfast": ["breakfast", "buffet", "morning meal", "croissant", "continental breakfast", "brekkie"],
    "service": ["staff", "service", "reception", "receptionist", "helpful", "friendly", "rude", "welcome", "welcoming", "host", "hostess", "manager", "employee", "concierge", "attentive", "polite", "unhelpful", "courteous"],
    "noise": ["noise", "noisy", "quiet", "loud", "soundproof", "sound proof", "silent", "silence", "traffic noise", "thin wall", "peaceful"],
    "room": ["room", "bed", "bedroom", "bathroom", "shower", "toilet", "spacious", "comfortable", "comfy", "mattress", "pillow", "air conditioning", "air con", "a/c", "heating", "cramped", "tiny room", "small room"],
    "value": ["value", "price", "expensive", "cheap", "worth", "money", "overpriced", "affordable", "cost", "pricey", "bargain", "value for money", "good deal", "reasonable price"],
}
ASPECTS = list(ASPECT_KEYWORDS)
# Texts that say nothing.
NEGATIVE_PLACEHOLDERS = ["no negative", "nothing", "nothing at all", "n/a", "na", "none", "nil", "no", "nothing to complain", "nothing to complain about", "everything was fine", "everything was perfect", "all good", "no complaints", "no complaint"]
POSITIVE_PLACEHOLDERS = ["no positive", "nothing", "nothing at all", "n/a", "na", "none", "nil", "no", "nothing to say", "everything was fine"]
# Countries at the end of an address, and cities in it.
COUNTRIES = ["United Kingdom", "United States of America", "Czech Republic", "Netherlands", "Switzerland", "Austria", "France", "Italy", "Spain", "Portugal", "Germany", "Belgium", "Ireland", "Hungary", "Poland", "Greece", "Sweden", "Norway", "Denmark", "Finland", "Romania", "Luxembourg"]
CITIES = ["London", "Paris", "Amsterdam", "Barcelona", "Vienna", "Milan"]


def squeeze(text: Column) -> Column:
    """White space at the ends dropped, runs of it made one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def normalise_placeholder(text: Column) -> Column:
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def is_placeholder(text: Column, phrases: list[str]) -> Column:
    # The lambda binds the normalised text, so it is made once.
    bare = lambda n: F.regexp_replace(n, "^[ .!,;]+|[ .!,;]+$", "")
    return F.get(F.transform(F.array(normalise_placeholder(text)), lambda n: (n == "") | n.isin(phrases) | bare(n).isin(phrases)), F.lit(0))


def gate_aspects(text: Column, keywords: dict[str, list[str]] = ASPECT_KEYWORDS) -> Column:
    """The aspects that a text names, in any case and in the order of the dictionary: a single word at a word's start,
    several words anywhere. A text is cut into words once, and only those that begin like some keyword are matched; all
    patterns over all of the text cost several times as much."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\u017f", "s")
    plain = {a: [w for w in words if re.fullmatch(r"\w+", w)] for a, words in keywords.items()}
    n = min(len(w) for words in plain.values() for w in words)
    heads = sorted({w[:n] for words in plain.values() for w in words})
    likely = lambda x: F.array_join(F.filter(F.split(x, r"[^\p{L}\p{N}_]+"), lambda w: F.substring(w, 1, n).isin(heads)), " ")

    def named(p: Column) -> Column:
        out = []
        for aspect, words in keywords.items():
            found = p["likely"].rlike("(?:^| )(?:" + "|".join(plain[aspect]) + ")") if plain[aspect] else F.lit(False)
            for w in words:
                if " " in w:
                    found = found | p["low"].contains(w)
                elif w not in plain[aspect]:
                    found = found | (p["low"].contains(w) & p["low"].rlike(r"(?<![\p{L}\p{N}_])" + re.escape(w)))
            out.append(F.when(found, F.lit(aspect)))
        return F.array(*out)

    # The lambdas bind the lowered text and its words, so each is made once.
    once = F.transform(F.array(low), lambda x: F.struct(x.alias("low"), likely(x).alias("likely")))
    return F.filter(F.flatten(F.transform(once, named)), lambda a: a.isNotNull())


def parse_city_country(address: Column, cities: list[str] = CITIES, countries: list[str] = COUNTRIES) -> tuple[Column, Column]:
    """City and country: a known country at the end, else the last token; a known city anywhere, else the token before the country."""
    a = squeeze(F.coalesce(address, F.lit("")))
    last = F.element_at(F.split(a, " "), -1)
    country = F.coalesce(*[F.when(a.endswith(c), F.lit(c)) for c in countries], last)
    rest = F.rtrim(F.substring(a, F.lit(1), F.greatest(F.length(a) - F.length(country), F.lit(0))))
    city = F.coalesce(*[F.when(a.contains(c), F.lit(c)) for c in cities], F.element_at(F.split(rest, " "), -1))
    return city, country


def unit_id(address: Column, prefix: str = "d1_europe:", length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.lower(squeeze_ends(address)).cast("binary")), 1, length))


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def review_fingerprint(address: Column, day: Column, score: Column, nation: Column, positive: Column, negative: Column) -> Column:
    """sha1 over the joined fields and the raw digests of the two texts."""
    head = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (address, day, score, nation)], F.lit(""))
    digest = [F.unhex(F.sha1(F.coalesce(t, F.lit("")).cast("binary"))) for t in (positive, negative)]
    return F.sha1(F.concat(F.encode(head, "UTF-8"), *digest))


def fold_of(fingerprint: Column) -> Column:
    """A if the number in the first eight hex digits is even, else B."""
    return F.when(F.substring(fingerprint, 8, 1).isin(list("02468ace")), "A").otherwise("B")


def clean_url(url: Column) -> Column:
    """Without query, fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")


def url_slug(url: Column) -> Column:
    """The last part of a URL's path, without its extensions."""
    return F.regexp_replace(F.element_at(F.split(clean_url(url), "/"), -1), r"\..*$", "")


def quote_formula(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^[\t\r\n]|^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def opaque_id(namespace: Column, item: Column) -> Column:
    return F.sha2(F.concat(namespace, F.chr(F.lit(0)), item.cast("string")), 256)


def normalise_choice(value: Column) -> Column:
    """Trimmed; blank is null."""
    t = F.trim(value)
    return F.when(t != "", t)


def json_int(json: Column, path: str) -> Column:
    return F.get_json_object(json, path).try_cast("bigint")


def fenced_json(text: Column) -> Column:
    """The first JSON object of an answer, from within a code fence if it has one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
