"""Steps, answers and confidences read from replies of a language model; tips found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
# Any one of these characters makes a sentence a tip.
TIP = "[注意要领技巧]"


def numbered_steps(lines: Column) -> Column:
    """array<string>: lines gathered under '1.', '2.' and so on, each number once and in turn. Lines before the first are left out."""
    none = F.array().cast("array<string>")

    def take(steps: Column, line: Column) -> Column:
        opens = F.startswith(F.btrim(line, F.lit(BLANKS)), F.concat((F.size(steps) + 1).cast("string"), F.lit(".")))
        longer = F.concat(F.slice(steps, 1, F.size(steps) - 1), F.array(F.concat(F.element_at(steps, -1), F.lit("\n"), line)))
        return F.when(opens, F.concat(steps, F.array(line))).when(F.size(steps) > 0, longer).otherwise(steps)

    return F.transform(F.aggregate(lines, none, take), lambda s: F.btrim(s, F.lit(BLANKS)))


def thought_and_answer(reply: Column) -> Column:
    """struct(steps, answer). A reply without a section of thoughts is its own answer; without numbered steps its first 500
    characters are the only step. With thoughts but no answer mark the answer is empty. Null counts as empty."""
    reply = F.coalesce(reply, F.lit(""))
    thinks = reply.rlike("思考过程[：:]")
    mark = F.when(F.contains(reply, F.lit("答案：")), "答案：").otherwise("答案:")
    at = F.position(mark, reply)
    thoughts = F.when(at > 0, F.substring(reply, F.lit(1), at - 1)).otherwise(reply)
    answer = F.when(at > 0, F.btrim(F.substring(reply, at + 3, F.length(reply)), F.lit(BLANKS))).otherwise("")
    steps = numbered_steps(F.split(F.btrim(thoughts, F.lit(BLANKS)), "\n"))
    steps = F.when(thinks & (F.size(steps) > 0), steps).otherwise(F.array(F.substring(reply, 1, 500)))
    return F.struct(steps.alias("steps"), F.when(thinks, answer).otherwise(reply).alias("answer"))


def thought_confidence(steps: Column, answer: Column) -> Column:
    """Half for up to 3.3 steps, half for an answer of up to 250 characters."""
    return F.round(F.least(F.size(steps) * 0.15, F.lit(0.5)) + F.least(F.length(answer) / 500, F.lit(0.5)), 2)


def action_confidence(steps: Column, actions: Column) -> Column:
    """0.3 without steps; else 0.1 a step up to 0.5 and 0.15 an action other than the last up to 0.3."""
    return F.when(steps == 0, 0.3).otherwise(F.round(F.least(steps * 0.1, F.lit(0.5)) + F.least(actions * 0.15, F.lit(0.3)), 2))


def graph_confidence(covered: Column, relations: Column) -> Column:
    """0.2 an entity of the question up to 0.4 and 0.05 a relation up to 0.4."""
    return F.round(F.least(covered * 0.2, F.lit(0.4)) + F.least(relations * 0.05, F.lit(0.4)), 2)


def practice_tips(text: Column, most: int = 5) -> Column:
    """The first sentences, with their ends, that hold one of the characters of a tip; a last one without an end is none. Linear in the text."""
    sentences = F.split(text, "(?<=[。！？])", -1)
    told = F.filter(sentences, lambda x: F.rlike(x, F.lit(TIP)) & F.substring(x, -1, 1).isin("。", "！", "？"))
    return F.slice(told, 1, most)
