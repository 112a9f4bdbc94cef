"""Column functions over text: tokens, titles, embeddings, cleaning, chunking, classification and masking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks the type of a question, in order of precedence.
COMPARISON = ("区别", "差异", "比较", "对比", "相同", "不同", "优劣", "优缺点", "和...的区别")
EXPLANATION = ("解释", "说明", "阐述", "描述", "介绍", "是什么", "什么是", "原理", "机制")
MULTI_HOP = ("为什么", "怎么", "如何", "原因", "关系", "联系", "影响", "导致", "因为", "所以")

# Names and patterns that error messages must not show.
SENSITIVE_WORDS = ("password", "token", "secret", "key", "credential", "auth", "connection.*string")

# Patterns of sensitive contents and what stands in their place, in the order in which they apply.
MASKS = (
    (r"(?i)eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "***TOKEN***"),
    (r"(?i)Bearer\s+[a-zA-Z0-9_.\-=]+", "Bearer ***TOKEN***"),
    (r"(?i)(AKIA)[0-9A-Z]{12}([0-9A-Z]{4})", "$1***$2"),
    (r"(?i)(AIza)[a-zA-Z0-9_-]{31}([a-zA-Z0-9_-]{4})", "$1***$2"),
    (r"\b([a-zA-Z0-9]{4})[a-zA-Z0-9]{24,}([a-zA-Z0-9]{4})\b", "$1***$2"),
    (r"(?i)(sk_l)ive_[a-zA-Z0-9]{20,}([a-zA-Z0-9]{4})", "$1***$2"),
    (r"(?i)(sk_t)est_[a-zA-Z0-9]{20,}([a-zA-Z0-9]{4})", "$1***$2"),
    (r"(1[3-9]\d)\d{4}(\d{4})", "$1****$2"),
    (r"(1[3-9]\d)-?\d{4}-?(\d{4})", "$1****$2"),
    (r"([1-9]\d{5})(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(\d{3}[\dXx])", "$1********$2"),
    (r"([1-9]\d{5})\d{2}(?:0[1-9]|1[0-2])(?:0([1-9]\d{3})|[12](\d{4})|3([01]\d{3}))", "$1*****$2$3$4"),
)
# Patterns of passwords in text, applied last.
PASSWORDS = (
    (r"(?i)([\"']?password[\"']?\s*[:=]\s*[\"'])[^\"']+([\"'])", "$1***$2"),
    (r"(?i)([\s?&]password=)[^&\s,\"]+", "$1***"),
    (r"(?i)(--password[-=]|\s-p\s+)\S+", "$1***"),
    (r"(?i)\b(password|pwd|passwd)\s*[=:]\s*[^\s,\"]+", "$1=***"),
)
# Card numbers by issuer, then any of sixteen digits.
CARDS = (r"\b4\d{12}(?:\d{3}|\d{6})?\b", r"\b5[1-5]\d{14}\b", r"\b3[47]\d{13}\b", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b")
TOKEN = r"[\p{L}\p{N}_]{2,}"
EMAIL = r"([a-zA-Z0-9._%+-]+)@((?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,})"


def any_of(text: Column, words) -> Column:
    """Whether text holds one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of two characters or more; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


def occurrences(text: Column, term: str) -> Column:
    """How often a token stands in a text; texts without its letters are told apart by a plain search."""
    low, edge = F.lower(F.coalesce(text, F.lit(""))), r"[\p{L}\p{N}_]"
    alone = rf"(?<!{edge})\Q{term}\E(?!{edge})"
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(alone))).otherwise(F.lit(0))


def title_of(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """Unit vector from the SHA-256 of a text; dimension i comes from byte i modulo 32."""
    byte = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5) * 2)
    raw = let(let(F.sha2(text, 256), byte), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.get(b, i % 32)))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(text.isNotNull(), let(raw, lambda r: let(norm(r), lambda n: F.transform(r, lambda x: x / n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def question_type(q: Column) -> Column:
    return F.when(any_of(q, COMPARISON), "comparison").when(any_of(q, EXPLANATION), "explanation").when(any_of(q, MULTI_HOP), "multi_hop").when(F.length(q) > 20, "reasoning").otherwise("factual")


def reason_mode(q: Column) -> Column:
    return F.when(any_of(q, ("关系", "区别")), "graph_rag").when(any_of(q, ("如何", "步骤")), "react").otherwise("cot")


def clean_text(text: Column) -> Column:
    """Collapses blanks, drops page numbers and control characters, blank lines and repeated lines (the first one stays)."""
    has = lambda c: F.contains(text, F.lit(c))
    passes = ((r"\n\s*\n", "\n\n"), (r" +", " "), (r"\t+", " "), (r"\n\s*\d+\s*\n", "\n"), (r"\n\s*第\s*\d+\s*页\s*\n", "\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""))
    guards = {p[0]: g for p, g in zip(passes, (has("\n"), has("  "), has("\t"), has("\n"), has("第")))}
    text = replaced(text, passes, guards)
    return F.array_join(F.array_distinct(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")), "\n")


def chunks(text: Column, size: int = 512, overlap: int = 50, longer_than: int | None = 50) -> Column:
    """array of (position, chunk): pieces of `size` characters every size - overlap, without those of `longer_than` characters or fewer."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda s: F.struct(s.alias("position"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
    least = 0 if longer_than is None else longer_than
    return F.filter(cut, lambda c: F.length(c["chunk"]) > least)


def redact(message: Column) -> Column:
    """Lower-cased error message with sensitive words replaced."""
    message = F.lower(message)
    for word in SENSITIVE_WORDS:
        message = F.regexp_replace(message, word, "[REDACTED]")
    return message


def mask_emails(text: Column) -> Column:
    """Local parts keep their first and last character, those of one or two characters none; one star for each hidden one."""

    def masked(address: Column) -> Column:
        local = F.substring_index(address, "@", 1)
        hidden = F.when(F.length(local) <= 2, F.repeat(F.lit("*"), F.length(local))).otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.length(local) - 2), F.substring(local, -1, 1)))
        return F.concat(hidden, F.lit("@"), F.substring_index(address, "@", -1))

    return let(text, lambda t: F.when(F.contains(t, F.lit("@")), replace_matches(t, EMAIL, masked)).otherwise(t))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def replace_matches(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern replaced by what `new` makes of it."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(new(m), F.lit(""))))
    return F.array_join(pairs, "")


def _masker(pattern: str, new: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.when(F.rlike(t, F.lit(pattern)), replace_matches(t, pattern, new)).otherwise(t)


def mask_cards(text: Column) -> Column:
    """Card numbers without their separators, a star for each digit but the last four."""

    def masked(card: Column) -> Column:
        digits = F.regexp_replace(card, r"[\s-]", "")
        return F.concat(F.repeat(F.lit("*"), F.length(digits) - 4), F.right(digits, F.lit(4)))

    for pattern in CARDS:
        text = let(text, _masker(pattern, masked))
    return text


def _when(guard: Column, pattern: str, new: str) -> Callable[[Column], Column]:
    return lambda t: F.when(guard, F.regexp_replace(t, pattern, new)).otherwise(t)


def replaced(text: Column, masks, guards: dict[str, Column] | None = None) -> Column:
    """text after each (pattern, replacement), in order. guards: by pattern, what any text that it can change fulfils; other texts skip it."""
    for pattern, new in masks:
        guard = (guards or {}).get(pattern)
        text = F.regexp_replace(text, pattern, new) if guard is None else let(text, _when(guard, pattern, new))
    return text


def mask_contents(text: Column) -> Column:
    """Tokens, keys, phones and identity numbers. Most texts have no such word and no long number, and skip those patterns."""
    literals = {m[0]: word for m, word in zip((MASKS[0], MASKS[1], MASKS[2], MASKS[3], MASKS[5], MASKS[6]), ("eyj", "bearer", "akia", "aiza", "sk_live_", "sk_test_"))}
    given = F.struct(F.lower(text).alias("low"), F.rlike(text, F.lit(r"\d{4}")).alias("digits"))

    def masked(g: Column) -> Column:
        guards = {p: F.contains(g["low"], F.lit(w)) for p, w in literals.items()} | {m[0]: g["digits"] for m in MASKS[7:]}
        return replaced(text, MASKS, guards)

    return let(given, masked)


def mask_sensitive(text: Column) -> Column:
    """The masks in their order: tokens, keys, phones, identity numbers, e-mail addresses, cards, passwords."""
    return replaced(mask_cards(mask_emails(mask_contents(text))), PASSWORDS)


def react_fields(reply: Column) -> Column:
    """thought, action and input of a reply; the action is 'finish' where none is given."""
    part = lambda name: F.trim(F.regexp_extract(reply, rf"(?i){name}:\s*([^\n]*)", 1))
    action = part("Action")
    return F.struct(part("Thought").alias("thought"), F.when(action == "", "finish").otherwise(action).alias("action"), part("Action Input").alias("input"))


def size_label(size: Column) -> Column:
    """Bytes with a unit and two decimals."""
    label, value = F.lit(None).cast("string"), size.cast("double")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB", "PB")))):
        bound = 1024.0 ** (power + 1)
        text = F.concat(F.format_string("%.2f", value / (1024.0**power)), F.lit(f" {unit}"))
        label = text if unit == "PB" else F.when(value < bound, text).otherwise(label)
    return label
