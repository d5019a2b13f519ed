"""Text cleaning, extraction and classification as Column functions. Three extraction profiles exist: regex (whole pages),
reader (metadata) and rules (entities with limits). A null text gives null; a text without hits an empty array. Where the
order of results was open, it is that of first occurrence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from . import patterns as P

ANY, EXACT = "(?iU)", "(?U)"


def hits(text: Column, pattern: str, flags: str = ANY, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def all_of(text: Column, patterns: list[str], flags: str = ANY) -> Column:
    """Matches of each pattern in turn, in order of place, with repeats."""
    return F.concat(*[hits(text, p, flags) for p in patterns])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), which may name its argument more than once: the value is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hoisted(patterns: list[str], opens: str = "") -> str:
    """P.either() of patterns that all begin at a word's edge, which is looked for once at a place and not for each of them; opens
    is a look-ahead that every match passes and that most places fail faster than the edge."""
    assert all(p.startswith(r"\b") for p in patterns)
    return rf"{opens}\b(?:{P.either([p[2:] for p in patterns])})"


def unbroken(run: str, rest: str) -> str:
    """run+ and rest, which does not begin with one of run, for a search: a run is tried from its first character alone, or from
    where the last match ended, since without its beginning it fails by the same rest."""
    return rf"(?:\G|(?<!{run})){run}++{rest}"


def first(items: Column, default: str | None = "") -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def contains_any(text: Column, words: list[str]) -> Column:
    return _let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))  # case is folded once


# cleaning


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_unicode(text: Column) -> Column:
    """Typographic quotes, sharp s, ligatures and dashes to ASCII; control characters but \\n\\r\\t dropped; stripped."""
    t = text  # signs that are rare: looking for each is cheaper than mapping every character
    for a, b in [*zip(P.QUOTES_FROM + "–", P.QUOTES_TO + "-", strict=True), *P.LIGATURES, ("—", "--"), ("ß", "ss")]:
        t = F.replace(t, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def clean_spaces(text: Column) -> Column:
    """Quotes, hard spaces, literal backslash-n and one frequent misreading repaired; white space runs as one space."""
    t = text  # signs that are rare: looking for each is cheaper than mapping every character
    for a, b in [*zip(P.QUOTES_FROM + " ", P.QUOTES_TO + " ", strict=True), ("\\n", " "), (" voop ", " voor "), *P.LIGATURES]:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"(?U)[^\S ]\s*| \s+", " "))  # a blank alone stays as it is


def clean_phone(phone: Column) -> Column:
    """Digits: international form if they start with 31, groups of 3 3 2 2 if ten, else the text as it was."""

    def formed(d: Column) -> Column:
        groups = F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 2), F.substring(d, 9, 2))
        return F.when(d.startswith("31"), F.concat(F.lit("+"), d)).when(F.length(d) == 10, groups).otherwise(phone)

    return _let(F.regexp_replace(phone, r"\D", ""), formed)


def name_from_file(name: Column) -> Column:
    """First_Last or First at the start, else letters-digits anywhere, underscore as space; null without any."""
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in P.FILE_NAMES]
    return F.replace(F.coalesce(*found), F.lit("_"), F.lit(" "))


def without_stars(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\*+", ""))


def label(field: Column, value: Column, most: int = 20) -> Column:
    """field: value, cut with three points behind most characters."""
    return F.concat(field, F.lit(": "), F.substring(value, 1, most), F.when(F.length(value) > most, "...").otherwise(""))


# dates


def dates(text: Column) -> Column:
    """Reader profile: distinct dates that exist in the calendar."""

    def valid(pattern: str, form: str) -> Column:
        one = lambda x: F.regexp_replace(x, r"(?U)\s+", " ")
        return F.filter(hits(text, pattern), lambda x: F.try_to_timestamp(one(x), F.lit(form)).isNotNull())

    return F.array_distinct(F.concat(*[valid(p, f) for p, f in P.READER_DATES]))


def is_valid_date(text: Column) -> Column:
    """Whether the whole text has the form of a date; points and slashes count as separators as hyphens do."""
    return text.rlike(f"{ANY}^(?:{P.either(P.VALID_DATES)})$")


def dates_regex(text: Column, literal: bool = False) -> Column:
    """Regex profile: distinct dates of valid form; literal gives the empty list that the first version always gave."""
    if literal:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    # how every one of them begins, which most figures fail at once
    return F.array_distinct(F.filter(hits(text, rf"(?=\d{{1,2}}[./\s-]|\d{{4}}[./-])(?:{P.either(P.REGEX_DATES)})"), is_valid_date))


def dates_rules(text: Column, most: int = 10) -> Column:
    """Rule profile: date entities, then dates with a year of 19xx or 20xx; the first distinct ones."""
    # the first of the dates is also an entity: where no entity names a month, its hits are the entities
    by_month, by_number = P.RULE_DATE_ENTITIES
    plain, written, month_first = P.RULE_DATES
    assert plain == by_number

    def both(found: Column) -> Column:
        none = F.array().cast("array<string>")
        again = F.when(F.exists(found, lambda x: x.rlike(r"\p{L}")), hits(text, hoisted([plain], r"(?=\d)"))).otherwise(none)
        dated = F.filter(F.concat(again, hits(text, hoisted([written], r"(?=\d)")), hits(text, month_first)), lambda x: x.rlike(r"(19|20)\d{2}"))
        return F.slice(F.array_distinct(F.concat(found, dated)), 1, most)

    return _let(hits(text, hoisted([by_month, by_number], r"(?=\d)")), both)


def parse_date(text: Column) -> Column:
    """Date of d-m-yyyy or d-m-yy, points read as hyphens; years 69 to 99 are 19xx, 00 to 68 20xx; else null."""
    p = r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$"
    t = F.replace(text, F.lit("."), F.lit("-"))
    d, m, y = (F.regexp_extract(t, p, k) for k in (1, 2, 3))
    year = F.when(F.length(y) == 4, y).when(y >= "69", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    return F.try_to_timestamp(F.concat_ws("-", year, m, d), F.lit("yyyy-M-d")).cast("date")


def latest(found: Column, most: int = 5) -> Column:
    """Those that parse, latest first, equal days in their order."""
    keyed = F.filter(F.transform(found, lambda x, i: F.struct((-F.unix_date(parse_date(x))).alias("k"), i.alias("i"), x.alias("v"))), lambda s: s.k.isNotNull())
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s.v), 1, most)


# numbers and ids


def document_numbers(text: Column) -> Column:
    return all_of(text, P.READER_NUMBERS)


def _from_its_run(pattern: str) -> str:
    """unbroken() of a pattern that begins with a run of letters, figures or address signs; any other as it is."""
    for run in ("[A-Za-z]", r"\d", "[a-zA-Z0-9._%+-]"):
        if pattern.startswith(run + "+"):
            return unbroken(run, pattern[len(run) + 1 :])
    return pattern


def document_numbers_regex(text: Column) -> Column:
    """Labelled numbers, slashed and dotted ones, and the bare number behind the sixth label."""
    return F.concat(all_of(text, [_from_its_run(p) for p in P.REGEX_NUMBERS]), hits(text, P.REGEX_NUMBER_BARE, ANY, 1))


def document_ids(text: Column, most: int = 3) -> Column:
    """Rule profile: ids in order of place, then references; comma read as point, other signs dropped, of 8 or more
    characters; the first distinct ones."""
    found = F.concat(hits(text, hoisted(P.RULE_IDS), EXACT), hits(text, P.RULE_REFERENCE))
    clean = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit(".")), r"(?U)[^\w./-]", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 8)), 1, most)


def ids_out_of_dates(found: Column, ids: Column) -> Column:
    """Struct of dates without those that have an id's form, and of the distinct ids with them."""
    is_id = lambda x: x.rlike(P.ID_AS_DATE)
    return F.struct(F.filter(found, lambda x: ~is_id(x)).alias("dates"), F.array_union(ids, F.filter(found, is_id)).alias("ids"))


def longest(found: Column, most: int = 3) -> Column:
    """Longest first, equal lengths in their order."""
    keyed = F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("k"), i.alias("i"), x.alias("v")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s.v), 1, most)


def amounts(text: Column) -> Column:
    return all_of(text, [_from_its_run(p) for p in P.REGEX_AMOUNTS])


# contacts


def emails(text: Column) -> Column:
    return F.array_distinct(hits(text, P.READER_EMAIL))


def emails_regex(text: Column) -> Column:
    return hits(text, _from_its_run(P.REGEX_EMAIL), "")  # the pattern names both cases itself


def emails_rules(text: Column, most: int = 2) -> Column:
    """Distinct addresses but those whose domain starts with example.com."""
    # an address has no blank, so only words with an @ are searched; no name has one, so none is tried again without its end
    text = F.array_join(F.filter(F.split(text, " "), lambda x: x.contains("@")), " ")
    return F.slice(F.array_distinct(hits(text, P.RULE_EMAIL.format(P.EMAIL_NOT_EXAMPLE).replace("+@", "++@"))), 1, most)


def phones(text: Column) -> Column:
    return F.array_distinct(all_of(text, P.READER_PHONES, EXACT))


def phones_regex(text: Column) -> Column:
    return F.transform(hits(text, r"(?=[+(]{0,2}\d{2})" + P.REGEX_PHONE, EXACT), clean_phone)


def phones_rules(text: Column, most: int = 3) -> Column:
    """The first that have 6 to 15 digits and signs. What the first pattern finds comes first, so the others are looked for only
    where that is not enough."""
    good = lambda found: F.filter(found, lambda x: x.rlike(r"^(?:[^\d+]*+[\d+]){6,15}[^\d+]*+\z"))
    head, *rest = P.RULE_PHONES
    return _let(good(hits(text, rf"(?=[+(\d]){head}", EXACT)), lambda found: F.slice(F.when(F.size(found) < most, F.concat(found, good(all_of(text, rest, EXACT)))).otherwise(found), 1, most))


# parties


def receiver(text: Column) -> Column:
    """The tax office's address if its block stands in the text, else empty."""
    return F.when(text.rlike("(?isU)" + P.TAX_OFFICE_BLOCK), P.TAX_OFFICE).otherwise("")


def sender(text: Column) -> Column:
    """The first block of name, street and town that is not the tax office's, else empty."""
    return strip(first(F.filter(hits(text, P.ADDRESS_BLOCK, EXACT), lambda x: ~x.contains("Belastingdienst"))))


def line_with(text: Column, words: list[str]) -> Column:
    """The topmost line that has one of the words, else empty."""
    has = lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words])

    def found(low: Column) -> Column:
        # case is folded once, and most texts have none of the words
        places = F.filter(F.transform(F.split(low, "\n"), lambda x, i: F.when(has(x), i)), lambda i: i.isNotNull())
        return F.when(has(low), F.get(F.split(text, "\n"), F.get(places, F.lit(0)))).otherwise("")

    return _let(F.lower(text), found)


def parties(text: Column, literal: bool = False) -> Column:
    """Struct of sender and receiver: by address blocks, else by keyword lines; literal leaves both empty."""
    if literal:
        return F.struct(F.lit("").alias("sender"), F.lit("").alias("receiver"))
    either = lambda a, b: _let(a, lambda x: F.when(x != "", x).otherwise(b))
    return F.struct(either(sender(text), line_with(text, P.SENDER_WORDS)).alias("sender"), either(receiver(text), line_with(text, P.RECEIVER_WORDS)).alias("receiver"))


def recipient_name(text: Column) -> Column:
    """The salutation with its name, else the first title-case word, barred words apart; else empty. A title-case word
    stands in for a proper noun, which takes a tagger to know."""
    ok = lambda x: ~contains_any(x, P.RECIPIENT_BARRED)
    one = lambda p: F.get(F.filter(hits(text, p, EXACT), ok), F.lit(0))
    return F.coalesce(one(P.RECIPIENT), one(P.TITLE_WORD), F.lit(""))


def recipient_address(text: Column) -> Column:
    """Street, number, postcode and town, or the last two; null without them."""
    # only a word's first letter can open the street, and no blank is one of its letters
    street, town = P.RECIPIENT_ADDRESS.split("|")
    return F.nullif(F.regexp_extract(text, EXACT + street.replace(r"\p{L}+\s\d", r"(?<!\p{L})\p{L}++\s\d", 1) + "|" + town, 0), F.lit(""))


def tax_office(text: Column) -> Column:
    """The first of tax_organisations(), else empty."""
    return F.coalesce(F.regexp_extract(text, rf"{ANY}(?=f){P.TAX_ORG}", 0), F.lit(""))  # most places fail by their letter


def tax_organisations(text: Column) -> Column:
    return hits(text, P.TAX_ORG)


def organisations(found: Column, most: int = 3) -> Column:
    """Organisation entities that look like names, without signs, the first distinct ones. Tokens are split at spaces."""

    def good(x: Column) -> Column:
        head = F.exists(F.slice(F.split(x, r"\s+"), 1, 2), lambda w: w.rlike(r"(?U)^(?:\p{Lu}\p{Ll}*|\p{Lu}+)\W*$"))
        words = F.split(F.lower(x), r"\s+")
        plain = ~F.exists(words, lambda w: w.rlike(r"^\d+$") | w.isin(*P.ARTICLES))
        return (F.length(x) >= 4) & ~contains_any(x, P.ORG_BARRED) & head & plain

    clean = F.transform(F.filter(F.transform(found, strip), good), lambda x: F.regexp_replace(x, r"[^a-zA-ZäöüßÄÖÜ\s-]", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 3)), 1, most)


def sending_organisation(found: Column) -> Column:
    """The first tax office, else the first organisation, else empty."""
    return F.coalesce(F.get(F.filter(found, lambda x: contains_any(x, ["finanzamt", "tax"])), F.lit(0)), first(found))


def tax_numbers(ids: Column) -> Column:
    return F.struct(first(F.filter(ids, lambda x: x.contains("/"))).alias("tax_number"), first(F.filter(ids, lambda x: F.lower(x).contains("idnr"))).alias("id_number"))


def metadata(text: Column) -> Column:
    """Dates, document numbers, e-mails and phones in one struct (reader profile)."""
    return F.struct(dates(text).alias("dates"), document_numbers(text).alias("document_numbers"), emails(text).alias("emails"), phones(text).alias("phones"))


# classes


def document_type(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("steuernummer"), "german_tax_id_assignment").when(t.contains("rechnung"), "invoice").otherwise("other")


def language_code(lang: Column, legacy: bool = False) -> Column:
    """Languages told apart, anything else English; the legacy code of German is du."""
    return F.when(lang == "de", "du" if legacy else "de").when(lang.isin("pl", "nl"), lang).otherwise("en")


def language_or_guess(lang: Column, text: Column) -> Column:
    """lang, or a guess between German and Dutch where detection failed (null)."""
    return F.coalesce(lang, F.when(F.lower(text).contains("finanzamt"), "de").otherwise("nl"))


def language_model(lang: Column) -> Column:
    """The model that serves a language: its own, else the German one."""
    return F.when(lang.isin("nl", "de", "en", "da", "fr"), lang).otherwise("de")


def language_or_unknown(lang: Column, text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\S"), F.coalesce(lang, F.lit("unknown"))).otherwise("unknown")


def _class(text: Column, classes: list[tuple[str, bool, list[str]]], default: str | None) -> Column:
    out = F
    for name, fold, patterns in classes:
        out = out.when(text.rlike((ANY if fold else EXACT) + P.either(patterns)), name)
    return out.otherwise(default)


def layout_class(text: Column) -> Column:
    """Date, document number, e-mail, phone, tried in that order, or null."""
    # every class has a digit or an @, and most texts have neither
    return F.when(text.rlike(r"(?U)[\d@]"), _class(text, P.LAYOUT_CLASSES, None))


def field_type(text: Column, default: str = "Unknown") -> Column:
    """Curation's class: date, document number, phone, e-mail, tried in that order, or the default."""
    return _class(text, P.CURATION_CLASSES, default)


def colour(field: Column) -> Column:
    """Red, green and blue of a field's box."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in P.COLOURS.items() for x in kv]), field), F.lit(P.COLOURS["Unknown"]))


# prompts and training rows

def listed(items: Column) -> Column:
    return F.array_join(items, ", ")


def prompt(text: Column, found_dates: Column, numbers: Column) -> Column:
    """Summary prompt: lists of dates and numbers, the text's first characters, and the sections asked for."""
    some = lambda a: F.coalesce(F.nullif(listed(a), F.lit("")), F.lit(P.PROMPT_NONE))
    parts = [F.lit(x) for x in P.PROMPT]
    return F.concat(parts[0], some(found_dates), parts[1], some(numbers), parts[2], F.substring(text, 1, P.PROMPT_CHARS), parts[3])


def training_target(lang: Column, entities: Column) -> Column:
    return F.concat(F.lit("<s_"), lang, F.lit("><s_dokument>"), F.to_json(entities), F.lit("</s>"))


def text_stats(text: Column) -> Column:
    """Characters, lines and words."""
    return F.struct(F.length(text).cast("long").alias("chars"), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("lines"), F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long").alias("words"))


def entity_structs(items: Column, most: int = 5) -> Column:
    """The first `most` entities as structs of value and bbox, which is null until they are linked with words."""
    return F.transform(F.slice(items, 1, most), lambda x: F.struct(x.alias("value"), F.lit(None).cast("array<int>").alias("bbox")))


def similarity(reference: Column, text: Column) -> Column:
    """1 - edit distance / longer length, 1 for two empty texts; our own definition."""
    n = F.greatest(F.length(reference), F.length(text))
    return similarity_of(F.levenshtein(reference, text), n)


def similarity_of(edits: Column, longer: Column) -> Column:
    """similarity() by the edit distance and the longer length; null without a distance."""
    return F.when((longer == 0) & edits.isNotNull(), 1.0).otherwise(1 - edits / F.nullif(longer, F.lit(0)))
