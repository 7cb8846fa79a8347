"""Column functions for marked-up transcript texts (all built-in expressions).

``(?U)`` makes ``\\s``, ``\\w`` and ``\\d`` cover Unicode, as the transcripts need.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of the transcript grammar.
SPEAKER_TAGS = ("דובר", "יור", "אורח", "קריאה", "דובר_המשך", "מנהל", "הלסי")
TOPIC_TAG, BUDGET_TAG = "נושא", "הצח"
TOPIC_TAGS = (TOPIC_TAG, BUDGET_TAG)
AGENDA = "סדר היום"

# Procedural phrases, removed in this order.
PROCEDURAL = (
    r"ה(?:פנייה|בקשה)(?: התקציבית)? נועדה ל(?:תקצב|תקצוב|העביר|העברת|העברה)",
    r"הבקשה דנה בסעיף",
    r"משנת(?: ה)?(?:תקציב)? \d{2,4}'? ל(?:שנת)?(?: ה)?(?:תקציב)? \d{2,4}'?",
    r"בהרשאה להתחייב",
    r"בהתאם ל(?:פירוט|ביצוע)(?: ה)?(?:תוכניות|תכניות)?(?: הבא(?:ה|ות))?",
    r"בחלוקה ל(?:תוכניות|תכניות)(?: הבאות)?",
    r"(?:העברת|העברה של) עודפ(?:ים|י)?",
    r"עודפי? תקציב(?:ית)?",
    r"(?:פני(?:ות|יה)|בקש(?:ה|ות))\s+מס'?\s*\d+(?:[-–]\d+)?",
    r"(?:פני(?:ות|יה)|בקש(?:ה|ות))\s+מספר\s*\d+(?:[-–]\d+)?",
    r"מי בעד\??\s*מי נגד\??\s*מי נמנע\??",
    r"ה(?:פנייה|בקשה) אושרה",
    r"תודה רבה",
    r"בבקשה",
    r"בוקר טוב",
    r"צהרים טובים",
    r"[\d,]+(?:\.\d+)?\s*(?:אלפי\s*)?(?:מיליון\s*)?(?:שקל(?:ים)?|ש\"ח|₪)",
)

# Ministries and authorities, and spelling variants with their canonical name.
MINISTRIES = ("משרד האוצר", "רשות המיסים", "רשות המסים", "משרד המשפטים", "משרד החינוך", "משרד הפנים", "משרד הבריאות", "משרד הכלכלה", "משרד הביטחון", "משרד הרווחה", "משרד השיכון", "משרד הבינוי והשיכון", "משרד החקלאות", "משרד התחבורה", "רשות התחרות", "המשרד להגנת הסביבה", "המשרד לביטחון לאומי", "רשות החברות הממשלתיות", "רשות החברות", "משרד התיירות", "משרד האנרגיה", "המשרד לביטחון פנים", "משרד הקליטה", "משרד העלייה והקליטה", "רשות האוכלוסין וההגירה", "רשות האוכלוסין", "משרד התרבות והספורט", "רשות החדשנות", "רשות הדואר", "המשרד לשירותי דת", "הרשות לניירות ערך", "המשרד לשוויון חברתי", "רשות החשמל", "משרד העבודה", "הרשות לזכויות ניצולי שואה", "הרשות לניצולי שואה", "משרד התקשורת", "משרד החוץ", "רשות מקרקעי ישראל", 'רמ"י', "בנק ישראל")
MINISTRY_VARIANTS = {"רשות המסים": "רשות המיסים", "משרד הבינוי והשיכון": "משרד השיכון", "משרד העלייה והקליטה": "משרד הקליטה", "רשות האוכלוסין": "רשות האוכלוסין וההגירה", "רשות החברות": "רשות החברות הממשלתיות", "הרשות לניצולי שואה": "הרשות לזכויות ניצולי שואה", 'רמ"י': "רשות מקרקעי ישראל"}

# Markers at which a generated reply is cut.
REPLY_STOPS = ("\nSESSION", "\nNEW SESSION", "\nEXISTING JOURNAL", "\n<segment>", "\nWORKED EXAMPLE", "\nBAD UPDATE", "\nGOOD UPDATE")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_numbering(c: Column) -> Column:
    """A leading list number ("3. ") goes, after trimming."""
    return F.regexp_replace(trim_ws(c), r"(?U)^\d+\.\s*", "")


def words(c: Column) -> Column:
    """White-space separated words; the empty array for blank text."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def snippet(c: Column, n: int) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def chunks(c: Column, size: int) -> Column:
    """Chunks of ``size`` words; a blank text is one empty chunk."""
    w = words(c)
    last = F.greatest(F.ceil(F.size(w) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "))


def titles_between(c: Column, tag: str) -> Column:
    """Clean titles between two occurrences of a tag, in order: repeated and empty ones too."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<<(?U:\s)*{tag}(?U:\s)*>>(.*?)<<(?U:\s)*{tag}(?U:\s)*>>"), 1)
    return F.transform(found, lambda x: normalize_ws(strip_numbering(x)))


def between_tags(c: Column, tag: str) -> Column:
    """Clean titles between two occurrences of a tag, distinct, in order."""
    return F.array_distinct(F.filter(titles_between(c, tag), lambda x: x != ""))


# Annotations that may follow an agenda item after a dash.
AGENDA_TAILS = ("הכנה לקריאה", "בקשה לדיון", "דיון והצבעות", "המשך", "הצבעות")


def agenda_items(c: Column) -> Column:
    """Items of the agenda block: up to a blank line, the attendance list or a remark."""
    block = F.regexp_extract(c, rf"(?s){AGENDA}(?U:[:\s])+(.*?)(?=\n\n|\nנכחו|\nהערה|$)", 1)
    items = F.split(trim_ws(block), r"\n(?U:\s)*\d+\.(?U:\s)+")
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(normalize_ws(strip_numbering(x)), rf"(?U:\s)*[-–](?U:\s)*({'|'.join(AGENDA_TAILS)}).*$", "")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def topics_with_method(c: Column) -> tuple[Column, Column]:
    """The first extractor that finds anything, and its name."""
    tries = [("noshaa", between_tags(c, TOPIC_TAG)), ("hatzach", between_tags(c, BUDGET_TAG)), ("agenda", agenda_items(c))]
    none = F.array().cast("array<string>")
    topics, method = none, F.lit("none")
    for name, found in reversed(tries):
        topics, method = F.when(F.size(found) > 0, found).otherwise(topics), F.when(F.size(found) > 0, name).otherwise(method)
    return topics, method


def first_speaker(c: Column) -> Column:
    """1-based position of the first speaker tag; 1 without one."""
    at = F.regexp_instr(c, F.lit(rf"<<(?U:\s)*({'|'.join(SPEAKER_TAGS)})(?U:\s)*>>"))
    return F.when(at > 0, at).otherwise(1)


def clean_span(c: Column) -> Column:
    """Speaker names (between two equal speaker tags) and all other tags go."""
    no_names = F.regexp_replace(c, rf"(?s)<<(?U:\s)*({'|'.join(SPEAKER_TAGS)})(?U:\s)*>>.*?<<(?U:\s)*\1(?U:\s)*>>", " ")
    return normalize_ws(F.regexp_replace(no_names, r"<<\s*[^>]+?\s*>>", " "))


def strip_procedural(c: Column) -> Column:
    return normalize_ws(functools.reduce(lambda t, p: F.regexp_replace(t, p, " "), PROCEDURAL, c))


def dictionary_matches(c: Column, names: tuple[str, ...], variants: dict[str, str]) -> Column:
    """Canonical names of the dictionary entries that the text contains, distinct."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(variants.get(n, n)).alias("canonical")) for n in names])
    return F.array_distinct(F.transform(F.filter(table, lambda x: F.contains(c, x["name"])), lambda x: x["canonical"]))


def normal_token(c: Column) -> Column:
    """Lower case; anything but word characters becomes one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def stable_ids(phrases: Column) -> Column:
    """Phrases of three characters or more, and their words of four or more, distinct."""
    clean = F.filter(F.transform(phrases, normal_token), lambda x: F.length(x) >= 3)
    return F.array_distinct(F.flatten(F.transform(clean, lambda p: F.concat(F.array(p), F.filter(F.split(p, " "), lambda w: F.length(w) >= 4)))))


def cut_reply(c: Column) -> Column:
    """A generated reply up to its first stop marker, trimmed."""
    out = trim_ws(c)
    for stop in REPLY_STOPS:
        out = F.when(F.contains(out, F.lit(stop)), trim_ws(F.substring_index(out, stop, 1))).otherwise(out)
    return out


def plausible_title(c: Column) -> Column:
    return (~F.contains(F.substring(c, 1, 30), F.lit("\n"))) & (F.length(c) < 300)


def script_safe(c: Column) -> Column:
    """JSON that may stand inside a script element."""
    for raw, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
