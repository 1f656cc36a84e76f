"""Text as column expressions: cleaning, clipping, slugs, tags, families, redaction, regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = " ...[truncated]"
CUT = "\n...[truncated]...\n"
# fixed values: markers of the protected region of a document
REGION_START = "<!-- LONGITUDINAL_MEMORY_START -->"
REGION_END = "<!-- LONGITUDINAL_MEMORY_END -->"
# fixed values: spellings of the task types
TASK_TYPES = {
    "pick_and_place": "pick_and_place",
    "pick_and_place_simple": "pick_and_place",
    "pick_two_obj_and_place": "pick_two_obj_and_place",
    "pick_two": "pick_two_obj_and_place",
    "look_at_obj_in_light": "look_at_obj_in_light",
    "look_at": "look_at_obj_in_light",
    "clean": "clean",
    "clean_and_place": "clean",
    "pick_clean_then_place_in_recep": "clean",
    "heat": "heat",
    "heat_and_place": "heat",
    "pick_heat_then_place_in_recep": "heat",
    "cool": "cool",
    "cool_and_place": "cool",
    "pick_cool_then_place_in_recep": "cool",
    "examine": "examine",
}
# fixed values: words that give a task description its family, first match wins
FAMILY_WORDS = [
    ("look_at_obj_in_light", ("desklamp", "under the lamp", "look at")),
    ("clean", ("clean", "wash")),
    ("heat", ("heat", "warm", "microwave")),
    ("cool", ("cool", "chill", "fridge", "refrigerator")),
    ("examine", ("examine", "inspect")),
]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(text: Column | str) -> Column:
    """White space of any kind to single spaces, trimmed; null gives ''."""
    return F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def strip(text: Column | str) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+\z", "")


def clip(text: Column | str, limit: int) -> Column:
    """First code points; a negative limit gives ''. Null gives ''."""
    return F.substring(F.coalesce(col(text), F.lit("")), 1, max(0, limit))


def compact(text: Column | str, limit: int | None) -> Column:
    """First code points; no limit or a negative one leaves the text whole."""
    text = F.coalesce(col(text), F.lit(""))
    return text if limit is None or limit < 0 else F.substring(text, 1, limit)


def shorten(text: Column | str, limit: int) -> Column:
    """Squeezed text of at most ``limit`` code points, with a mark where something was cut."""
    text = squeeze(text)
    if limit <= 0:
        return text
    cut = F.rtrim(F.substring(text, 1, limit if limit <= 20 else limit - len(ELLIPSIS)))
    cut = cut if limit <= 20 else F.concat(cut, F.lit(ELLIPSIS))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def cut_middle(text: Column, limit: int) -> Column:
    """Keep both ends of a text that is longer than ``limit``."""
    half = limit // 2
    if limit <= 0:
        return text
    ends = F.concat(F.substring(text, 1, half), F.lit(CUT), F.right(text, F.lit(half)))
    return F.when(F.char_length(text) > limit, ends).otherwise(text)


def or_else(*values: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def slug(value: Column | str, fallback: str) -> Column:
    """Lower-case name of letters, digits and underscores; ``gpt_`` at the start loses its mark."""
    text = or_else(F.btrim(F.coalesce(col(value), F.lit(""))), F.lit(fallback))
    text = F.replace(F.lower(base_name(text)), F.lit("."), F.lit(""))
    text = F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))
    return or_else(F.regexp_replace(text, "^gpt_", "gpt"), F.lit(fallback))


def model_slug(value: Column | str, fallback: str) -> Column:
    text = or_else(F.btrim(F.coalesce(col(value), F.lit(""))), F.lit(fallback))
    text = F.btrim(F.regexp_replace(F.lower(base_name(text)), "[^a-z0-9.]+", "_"), F.lit("_."))
    return or_else(F.regexp_replace(text, r"\.{2,}", "."), F.lit(fallback))


def safe_part(value: Column | str, limit: int = 80, fallback: str = "item") -> Column:
    """A name fit for a path."""
    text = F.btrim(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"[^A-Za-z0-9_.\-]+", "_"), F.lit("._"))
    return or_else(F.substring(text, 1, limit), F.lit(fallback))


def underscored(value: Column | str) -> Column:
    text = F.lower(strip(F.coalesce(col(value), F.lit(""))))
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))


def task_type(value: Column | str) -> Column:
    """Canonical task type; null for an unknown one."""
    table = F.create_map(*(F.lit(x) for pair in TASK_TYPES.items() for x in pair))
    return F.try_element_at(table, underscored(value))


def science_family(value: Column | str) -> Column:
    """Family of a numbered task name, its number dropped; null if nothing is left."""
    text = F.lower(strip(F.coalesce(col(value), F.lit(""))))
    text = F.regexp_replace(text, r"^task[_ \-]*\d+[_ \-]*", "")
    return F.nullif(F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def family_for(dataset: str, value: Column | str) -> Column:
    if dataset in ("scienceworld", "science_world"):
        return science_family(value)
    return task_type(value) if dataset == "alfworld" else F.coalesce(task_type(value), science_family(value))


def described_family(description: Column | str) -> Column:
    """Family named by the words of a task description."""
    text = F.lower(F.coalesce(col(description), F.lit("")))
    out = None
    for family, words in FAMILY_WORDS:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("pick_and_place")


def tagged(text: Column | str, tag: str) -> Column:
    """Content of the first <tag>...</tag>, whatever its case; '' if there is none."""
    return F.regexp_extract(F.coalesce(col(text), F.lit("")), rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1)


def normal_action(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(squeeze(text)), r"\.$", "")


def match_action(said: Column | str, admissible: Column | str) -> Column:
    """The admissible action meant: the same, alike after normalisation, or the only one named in it."""
    said = strip(F.coalesce(col(said), F.lit("")))
    actions = F.filter(F.transform(col(admissible), lambda a: strip(a)), lambda a: F.coalesce(a, F.lit("")) != "")
    alike = F.filter(actions, lambda a: F.lower(squeeze(a)) == F.lower(squeeze(said)))
    named = F.filter(actions, lambda a: F.lower(said).contains(F.lower(a)))
    return (
        F.when(F.coalesce(F.array_contains(actions, said), F.lit(False)), said)
        .when(F.size(alike) > 0, F.get(alike, F.lit(0)))
        .when(F.size(named) == 1, F.get(named, F.lit(0)))
        .otherwise(said)
    )


def variant_id(task_id: Column | str) -> Column:
    """(family, variant) of ``family_variant``; null unless the variant is 1, 2 or 3."""
    task_id = col(task_id)
    family = F.regexp_extract(task_id, "^(.+)_([^_]*)$", 1)
    variant = F.regexp_extract(task_id, "^(.+)_([^_]*)$", 2).try_cast("int")
    return F.when((family != "") & variant.between(1, 3), F.struct(family.alias("family"), variant.alias("variant")))


def error_summary(text: Column | str, limit: int = 180) -> Column:
    """Title of an HTML error page, else its text, squeezed and cut; never empty."""
    text = F.coalesce(col(text), F.lit(""))
    title = r"(?is)<title>(.*?)</title>"
    said = F.when(F.regexp_like(text, F.lit(title)), F.regexp_extract(text, title, 1)).otherwise(F.regexp_replace(text, "<[^>]+>", " "))
    said = squeeze(said)
    cut = F.concat(F.rtrim(F.substring(said, 1, limit)), F.lit("..."))
    return or_else(F.when(F.char_length(said) > limit, cut).otherwise(said), F.lit("no response body"))


# fixed values: what names a secret, in keys and in assignments
SECRET_KEY = (
    r"(?:password|passcode|access[_-]?token|refresh[_-]?token|verification[_-]?code|"
    r"one[_-]?time[_-]?code|otp|api[_-]?key|secret|cvv|card[_-]?number)"
)
SECRET_WORDS = "password|passcode|token|secret|otp|verification_code|api_key|cvv|card_number"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+\-/=]+"


def redact(text: Column | str) -> Column:
    """Quoted secret assignments and bearer tokens without their values."""
    quoted = rf"(?i)(\b(?:[a-z0-9_]*(?:{SECRET_WORDS})[a-z0-9_]*)\b\s*(?::|=)\s*)(['\"])(.*?)(\2)"
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), quoted, "$1$2[REDACTED]$4"), BEARER, "Bearer [REDACTED]")


def url_list(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda u: F.btrim(u)), lambda u: u != "")


def has_region(doc: Column) -> Column:
    return (F.locate(REGION_START, doc) > 0) & (F.locate(REGION_END, doc) > F.locate(REGION_START, doc))


def region(doc: Column | str) -> Column:
    """Trimmed text of the first protected region; '' if there is none."""
    return F.regexp_extract(F.coalesce(col(doc), F.lit("")), rf"(?s){REGION_START}\s*(.*?)\s*{REGION_END}", 1)


def without_regions(doc: Column | str) -> Column:
    """Text without protected regions; of an unbalanced one only the marker goes."""
    text = F.regexp_replace(F.coalesce(col(doc), F.lit("")), rf"(?s){REGION_START}.*?{REGION_END}", "")
    return F.replace(F.replace(text, F.lit(REGION_START), F.lit("")), F.lit(REGION_END), F.lit(""))


def with_region(doc: Column | str, content: Column | str) -> Column:
    """The document with one region at its end that holds ``content``."""
    body = F.regexp_replace(without_regions(doc), r"(?U)\s+\z", "")
    return F.concat(body, F.lit(f"\n\n{REGION_START}\n"), strip(col(content)), F.lit(f"\n{REGION_END}\n"))


def in_region(doc: Column, target: Column) -> Column:
    """Whether the first occurrence of ``target`` lies in the protected region."""
    at, start, end = F.locate(target, doc) if isinstance(target, str) else F.position(target, doc), F.locate(REGION_START, doc), F.locate(REGION_END, doc)
    return (at > start) & (at < end) & (start > 0)


def append_before_region(doc: Column, content: Column) -> Column:
    """Append a paragraph, before the protected region where there is one."""
    at = F.locate(REGION_START, doc)
    head = F.when(at > 0, F.substring(doc, F.lit(1), at - 1)).otherwise(doc)
    head = F.regexp_replace(head, r"(?U)\s+\z", "")
    tail = F.when(at > 0, F.concat(F.lit("\n\n"), F.substring(doc, at, F.char_length(doc)))).otherwise(F.lit("\n"))
    return F.concat(head, F.when(head == "", F.lit("")).otherwise(F.lit("\n\n")), strip(content), tail)


def attempt_label(attempt: Column, most: int) -> Column:
    return F.format_string(f"attempt %d/{most}", attempt) if most > 0 else F.format_string("attempt %d", attempt)
