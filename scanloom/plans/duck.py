"""DuckDB SQL of the extraction rules over a column text, for the oracles."""

from __future__ import annotations

from ..functions import patterns as P


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(pattern: str, fold: bool = True, group: int = 0, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {quoted(('(?i)' if fold else '') + pattern)}, {group})"


def chain(lists: list[str]) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


def every(patterns: list[str], fold: bool = True, text: str = "text") -> str:
    return chain([hits(p, fold, 0, text) for p in patterns])


def keep(items: str, condition: str) -> str:
    """Elements v that meet the condition."""
    return f"list_filter({items}, lambda v: {condition})"


def distinct(items: str) -> str:
    """Distinct elements in first order."""
    return f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


FORMATS = {"dd-MM-yyyy": "%d-%m-%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy-MM-dd": "%Y-%m-%d", "d MMMM yyyy": "%d %B %Y"}


def reader_dates() -> str:
    return distinct(chain([keep(hits(p), f"try_strptime(regexp_replace(v, '\\s+', ' ', 'g'), '{FORMATS[f]}') IS NOT NULL") for p, f in P.READER_DATES]))


def regex_dates() -> str:
    return distinct(keep(hits(P.either(P.REGEX_DATES)), f"regexp_full_match(v, {quoted('(?i)' + P.either(P.VALID_DATES))})"))


def rule_dates(text: str = "text") -> str:
    dated = keep(every(P.RULE_DATES, True, text), "regexp_matches(v, '(19|20)\\d{2}')")
    return f"{distinct(chain([hits(P.either(P.RULE_DATE_ENTITIES), True, 0, text), dated]))}[1:10]"


def regex_numbers() -> str:
    return chain([every(P.REGEX_NUMBERS), hits(P.REGEX_NUMBER_BARE, True, 1)])


def ids(text: str = "text") -> str:
    found = chain([hits(P.either(P.RULE_IDS), False, 0, text), hits(P.RULE_REFERENCE, True, 0, text)])
    clean = f"list_transform({found}, lambda v: regexp_replace(replace(v, ',', '.'), '[^\\w./-]', '', 'g'))"
    return f"{distinct(keep(clean, 'length(v) >= 8'))}[1:3]"


def rule_emails(text: str = "text") -> str:
    return f"{distinct(keep(hits(P.RULE_EMAIL.format(''), True, 0, text), 'NOT contains(lower(v), ' + quoted('@example.com') + ')'))}[1:2]"


def rule_phones(text: str = "text") -> str:
    return keep(every(P.RULE_PHONES, False, text), "length(regexp_replace(v, '[^\\d+]', '', 'g')) BETWEEN 6 AND 15") + "[1:3]"


def clean_phone(n: str) -> str:
    d = f"regexp_replace({n}, '\\D', '', 'g')"
    return f"CASE WHEN starts_with({d}, '31') THEN concat('+', {d}) WHEN length({d}) = 10 THEN concat({d}[1:3], ' ', {d}[4:6], ' ', {d}[7:8], ' ', {d}[9:10]) ELSE {n} END"


def regex_phones() -> str:
    return f"list_transform({hits(P.REGEX_PHONE, False)}, lambda v: {clean_phone('v')})"


def parsed(v: str) -> str:
    """Date of d-m-yyyy or d-m-yy."""
    d = f"replace({v}, '.', '-')"
    return f"CASE WHEN regexp_full_match({d}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({d}, '%d-%m-%Y') WHEN regexp_full_match({d}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{2}}') THEN try_strptime({d}, '%d-%m-%y') END"


def any_word(v: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({v}), {quoted(w)})" for w in words) + ")"


def sender() -> str:
    block = keep(hits(P.ADDRESS_BLOCK, False), "NOT contains(v, 'Belastingdienst')")
    return f"coalesce(nullif(coalesce({block}[1], ''), ''), {keep('string_split(text, chr(10))', any_word('v', P.SENDER_WORDS))}[1], '')"


def receiver() -> str:
    line = f"coalesce({keep('string_split(text, chr(10))', any_word('v', P.RECEIVER_WORDS))}[1], '')"
    return f"CASE WHEN regexp_matches(text, {quoted('(?is)' + P.TAX_OFFICE_BLOCK)}) THEN {quoted(P.TAX_OFFICE)} ELSE {line} END"


def recipient(text: str) -> str:
    found = keep(chain([hits(P.RECIPIENT, False, 0, text), hits(P.TITLE_WORD, False, 0, text)]), "NOT " + any_word("v", P.RECIPIENT_BARRED))
    return f"coalesce(({found})[1], '')"


def classes(v: str, rules: list[tuple[str, bool, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({v}, {quoted(('(?i)' if fold else '') + P.either(ps))}) THEN '{name}'" for name, fold, ps in rules) + f" ELSE {default} END"


QUOTES = r"replace(replace(replace(replace(text, '“', '\"'), '”', '\"'), '‘', ''''), '’', '''')".replace('\\"', '"')
LIGATURES = "replace(replace({}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
UNICODE = f"regexp_replace(regexp_replace(replace(replace({LIGATURES.format(f'replace({QUOTES}, chr(8211), chr(45))')}, chr(8212), '--'), 'ß', 'ss'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '^\\s+|\\s+$', '', 'g')"
PLAIN = f"trim(regexp_replace({LIGATURES.format(f'''replace(replace(replace({QUOTES}, chr(160), ' '), '\\n', ' '), ' voop ', ' voor ')''')}, '\\s+', ' ', 'g'))"

#: words of layout.ocr_words over documents, the confident ones
WORDS = r"SELECT doc_id AS image_id, p AS word_idx, l[p + 1] AS text, (p % n) * 85 + CASE WHEN p % n >= 2 AND (p // n) % 2 = 0 THEN 600 ELSE 0 END AS x, (p // n) * 40 + (p % n) * 3 AS y, 8 * least(length(l[p + 1]), 10) AS w, 12 + p % 4 AS h, 40 + (7 * p) % 60 AS conf FROM (SELECT doc_id, 2 + doc_id % 11 AS n, l, unnest(range(len(l))) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda v: v <> '') AS l FROM documents)) WHERE 40 + (7 * p) % 60 > 50"
