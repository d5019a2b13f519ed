"""Fixed values of the extraction rules. Patterns use only what Java's regex and RE2 share, but for the one look-ahead
that `EMAIL_NOT_EXAMPLE` names. Lists are in the order in which the rules are tried."""

# Replacements of the two cleaning profiles.
QUOTES_FROM, QUOTES_TO = "“”‘’", "\"\"''"
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl")]

# The regex profile (any case).
REGEX_NUMBERS = [r"Rechnung(?:s-?)?(?:nummer|nr\.?)[:.\s]*[A-Za-z0-9_/-]+", r"Beleg(?:nummer|nr\.?)[:.\s]*[A-Za-z0-9_/-]+", r"Factuurnr\.?[:.\s]*[A-Za-z0-9_/-]+", r"[A-Za-z]+/[A-Za-z]+/\d+/\d+[A-Za-z]*", r"\d{4}\.\d{2}\.\d{3}"]
REGEX_NUMBER_BARE = r"Rechnung\s+Nr\.\s+([\w\-/]+)"
REGEX_DATES = [r"\d{2}[./-]\d{2}[./-]\d{4}", r"\d{2}[./-]\d{2}[./-]\d{2}", r"\d{4}[./-]\d{2}[./-]\d{2}", r"\d{1,2}\.\s*[A-Za-zäöüÄÖÜß]+\s*\d{4}", r"\d{1,2}\s+[A-Za-zäöüÄÖÜß]+\s+\d{4}", r"\d{1,2}-[a-z]{3}-\d{2}", r"\d{1,2}\s+[a-z]{3,}\s+\d{4}"]
VALID_DATES = [r"\d{1,2}[-\s][A-Za-z]{3,}[-\s]\d{2,4}", r"\d{1,2}[-./\s]\d{1,2}[-./\s]\d{2,4}", r"\d{1,2}\s[A-Za-z]+\s\d{4}", r"\d{4}[-./\s]\d{1,2}[-./\s]\d{1,2}"]
REGEX_AMOUNTS = [r"\d+(?:\.\d{3})*,\d{2}\s*€", r"€\s*\d+(?:\.\d{3})*,\d{2}", r"Rechnungsbetrag:?\s*\d+(?:\.\d{3})*,\d{2}", r"Summe:?\s*\d+[,.]\d{2}"]
REGEX_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
REGEX_PHONE = r"\+?\(?\d{2,3}\)?[-.\s]?\d{2,3}[-.\s]?\d{2}[-.\s]?\d{2}[-.\s]?\d{2,3}"
ID_AS_DATE = r"^\d{4}\.\d{2}\.\d{3}$"
TAX_OFFICE_BLOCK, TAX_OFFICE = r"Belastingdienst.*Postbus\s2536.*6401\sDA\sHEERLEN", "Belastingdienst\nPostbus 2536\n6401 DA HEERLEN"
ADDRESS_BLOCK = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*\n(?:[A-Za-z]+\.?\s)?[A-Za-z0-9 ]+[- ]\d+\s*[A-Z]*\n\d{4}\s[A-Z]{2}\s[A-Za-z]+"
SENDER_WORDS, RECEIVER_WORDS = ["absender", "nadawca", "from:", "afzender"], ["empfänger", "adresat", "to:", "ontvanger", "an:"]
FILE_NAMES = [r"^([A-Z][a-z]+_[A-Z][a-z]+)", r"^([A-Z][a-z]+)", r"([A-Za-z]+-\d+)"]

# The reader profile (any case; phones as they are).
READER_DATES = [(r"\b\d{2}-\d{2}-\d{4}\b", "dd-MM-yyyy"), (r"\b\d{2}/\d{2}/\d{4}\b", "dd/MM/yyyy"), (r"\b\d{4}-\d{2}-\d{2}\b", "yyyy-MM-dd"), (r"\b\d{1,2}\s+[a-z]+\s+\d{4}\b", "d MMMM yyyy")]
READER_NUMBERS = [r"\b[A-Z]{2,}/\d{3,}/\d{4}\b", r"\bNr\s*\.?\s*\d{3,}[/-]\d{3,}\b", r"\b\d{3,}[/-]\d{3,}\b"]
READER_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
READER_PHONES = [r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", r"\b\d{2}[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", r"\+\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b"]

# The rule profile, whose token patterns are written over text.
MONTHS_DE = "januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember"
RULE_DATE_ENTITIES = [rf"\b\d{{1,2}}\.\s?(?:{MONTHS_DE})\s\d{{4}}\b", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"]
RULE_DATES = [r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", rf"\b\d{{1,2}}\s+(?:{MONTHS_DE})\s+\d{{4}}\b", r"\b(?:jan|feb|mär|apr|mai|jun|jul|aug|sep|okt|nov|dez)[a-z]*\s+\d{1,2},?\s+\d{4}\b"]
RULE_IDS = [r"\b\d{4}[.,]\d{2}[.,]\d{3}\b", r"\b[A-Z]{2,4}/[A-Z]{2,4}/\d{2}/\d{3,4}[A-Z]?\b", r"\b(?i:idnr|id-nr|steuernummer|steuernr)[.:]?\s\d{2}\s\d{3}\s\d{3}\s\d{3}\b", r"\b(?i:steuernummer|steuernr)\s\d{3}/\d{4}/\d{4}\b"]
RULE_REFERENCE = r"\b(?:kenmerk|nr|referentie)[.:]?\s[\w./-]{6,}"
RULE_PHONES = [r"(?:\+?\d{2,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{3,5}[-.\s]?\d{3,4}", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{3}\b", r"\b\d{2,4}/\d{3,8}\b"]
RULE_EMAIL, EMAIL_NOT_EXAMPLE = r"\b[\w.-]+@{}[\w.-]+\.(?:[a-z]{{2,8}}|xn--[a-z0-9]+)\b", r"(?!example\.com)"
TAX_ORG = r"\bfinanzamt(?:\s\p{L}+)*"
RECIPIENT = r"\b(?:(?i:für|fur)\s(?i:herrn|frau|herr|hr)|(?i:sehr)\s(?i:geehrte))\s\p{Lu}\p{Ll}{2,}"
TITLE_WORD = r"\b\p{Lu}\p{Ll}{2,}\b"
RECIPIENT_BARRED = ["festgesetzt", "solidaritatszuschlag", "einkommensteuer", "steuer", "bescheid", "seite", "anlage"]
RECIPIENT_ADDRESS = r"\p{L}+\s\d+\s?,\s?\d{5}\s\p{L}+|\b\d{5}\s+\p{L}+"
ORG_BARRED = ["einspruch", "einkünfte", "festgesetzt", "seite", "anlage", "steuer", "bescheid", "finanzamt", "antrag"]
ARTICLES = ["der", "die", "das"]

# Field classes of layout fields (C1) and of curation (C2).
MONTHS_EN = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LAYOUT_CLASSES = [
    ("Date", True, [r"\b\d{1,2}[-./]\d{1,2}[-./]\d{2,4}\b", r"\b\d{4}[-./]\d{1,2}[-./]\d{1,2}\b", rf"\b\d{{1,2}}\s+(?:{MONTHS_EN})\s+\d{{4}}\b"]),
    ("Document_Number", True, [r"\b[A-Z]{1,3}[-./]\d{3,}[-./]\d{2,4}\b", r"\bNr\.?\s*\d{3,}[/-]\d{2,}\b", r"\b\d{3,}[/-]\d{3,}\b", r"\bID\s*\d{4,}\b", r"\bREF\s*[:.]?\s*\d{4,}\b"]),
    ("Email", False, [READER_EMAIL]),
    ("Phone", False, [r"\b(?:\+\d{1,3}\s?)?(?:\(\d{1,4}\)|\d{1,4})[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,4}\b", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{3,4}\b", r"\b\d{2}[-.\s]?\d{3}[-.\s]?\d{2}[-.\s]?\d{2}\b", r"\+\d{1,3}\s?\d{2,3}\s?\d{3}\s?\d{2,4}\b"]),
]
CURATION_CLASSES = [
    ("Date", True, [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}/\d{2}/\d{4}\b", r"\bDatum\b.*\d{4}"]),
    ("DocumentNumber", True, [r"\b[A-Z]{2,}/\d{3,}/\d{4}\b", r"\b\d{3,}-\d{3,}\b"]),
    ("Phone", True, [r"\b\+\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b"]),
    ("Email", True, [READER_EMAIL]),
]
COLOURS = {"Date": "0,255,0", "Document_Number": "0,0,255", "Email": "255,0,0", "Phone": "255,165,0", "Unknown": "128,0,128"}

# The summary prompt around dates, numbers and text.
PROMPT_NONE, PROMPT_CHARS = "Brak", 28000
PROMPT = [
    "Przeanalizuj ten dokument i przygotuj podsumowanie w języku polskim:\n        \nMetadane dokumentu:\n- Daty: ",
    "\n- Numery: ",
    "\n\nTreść dokumentu (pierwsze 28K znaków):\n",
    "\n\nPrzygotuj podsumowanie w następującym formacie:\nTyp: [typ dokumentu]\n[linijka przerwy]\nStrony: [nadawca] → [odbiorca]\n[linijka przerwy]\nKluczowe daty: [lista] → [wytłumaczenie]\n[linijka przerwy]\nKwoty: [wykryte]\n[linijka przerwy]\nDane kontaktowe: [lista] → [wytłumaczenie]\n[linijka przerwy]\nPodsumowanie: [2-3 zdania po polsku]",
]


def either(patterns: list[str]) -> str:
    """One pattern for any of several, the first in the list winning at a place."""
    return "|".join(f"(?:{p})" for p in patterns)
