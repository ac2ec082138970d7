"""Column functions over texts: lines, white space, source normalisation, prompts and completions.

All are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of Python's str.splitlines and the white space of str.strip (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANK = r"(?U)[\s\x1c-\x1f\x85  ]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same characters, as functions that trim take them.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c) -> Column:
    """Without white space at both ends, Unicode white space and separators included."""
    return F.trim(_col(c), F.lit(WHITE))


def rstrip(c) -> Column:
    return F.rtrim(_col(c), F.lit(WHITE))


def lstrip(c) -> Column:
    return F.ltrim(_col(c), F.lit(WHITE))


def splitlines(c) -> Column:
    """Lines without their ends; a last empty one does not count, an empty text has none."""
    return bind(F.split(_col(c), LINE_END), lambda parts: F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(c) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(_col(c), f"{BLANK}+"), lambda x: x != "")


def single_spaced(c) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(_col(c), f"{BLANK}+", " "))


def lines_to_text(lines) -> Column:
    """Lines joined by LF with a final LF; no lines give an empty text."""
    lines = _col(lines)
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


# -- source normalisation -------------------------------------------------------------------------------------------

#: Header and statement forms (fixed values).
HEADER = r"^\+\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
PACKED = r"^\+(\d{10})(\d{10})(\d{10})(\d{10})(\d{10})$"
STATEMENT = r"(?i)^(\d{1,4})\+?\s+(.+?)\s+(f|ff)\s*$"


def normalise_header(line) -> Column:
    """``+ a b c d e`` of a spaced or packed header, null for any other line."""

    def shown(s, form):
        numbers = F.array(*(F.regexp_extract(s, form, i) for i in range(1, 6)))
        return F.concat_ws(" ", F.lit("+"), F.transform(numbers, lambda n: F.regexp_replace(n, r"^0+(?=\d)", "")))

    return bind(strip(line), lambda s: F.when(s.rlike(PACKED), shown(s, PACKED)).when(s.rlike(HEADER), shown(s, HEADER)))


def normalise_source(text) -> Column:
    """struct(text, error): the canonical source, or why there is none.

    Errors: empty, header, continuation, statement, unterminated; the first in
    line order.  Lines after the first final statement do not count.  Each step
    is bound, so that the steps after it do not work it out again.
    """

    def statement(line):
        return bind(strip(line), lambda s: F.when(s.rlike(STATEMENT), known(s)).otherwise(unknown(s)))

    def known(s):
        term = F.lower(F.regexp_extract(s, STATEMENT, 3))
        body = F.lower(single_spaced(F.regexp_extract(s, STATEMENT, 2)))
        number = F.lpad(F.regexp_extract(s, STATEMENT, 1).try_cast("int").cast("string"), 4, "0")
        # statements begin with a digit, so none is a continuation
        return F.struct(F.concat(number, F.lit("+ "), body, F.lit(" "), term).alias("line"), F.lit(None).cast("string").alias("error"), (term == "ff").alias("final"))

    def unknown(s):
        error = F.when(s.startswith("+"), "continuation").otherwise("statement")
        return F.struct(F.lit(None).cast("string").alias("line"), error.alias("error"), F.lit(False).alias("final"))

    def upto_end(every):
        # up to and including the first line that ends the program or is wrong
        stop = F.array_position(F.transform(every, lambda x: x["final"] | x["error"].isNotNull()), True)
        return bind(stop, lambda stop: F.when(stop > 0, F.slice(every, 1, stop.cast("int"))).otherwise(every))

    def source(lines):
        every = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), statement)
        parts = F.struct(F.size(lines).alias("n"), normalise_header(F.try_element_at(lines, F.lit(1))).alias("head"), bind(every, upto_end).alias("used"))
        return bind(parts, lambda p: outcome(p["n"], p["head"], p["used"]))

    def outcome(n, head, used):
        last = F.try_element_at(used, F.lit(-1))  # only the last of these lines can be wrong or final
        error = F.when(n == 0, "empty").when(head.isNull(), "header").when(last["error"].isNotNull(), last["error"]).when(~F.coalesce(last["final"], F.lit(False)), "unterminated")
        out = lines_to_text(F.concat(F.array(head), F.transform(used, lambda x: x["line"])))
        return bind(error, lambda e: F.struct(F.when(e.isNull(), out).alias("text"), e.alias("error")))

    return bind(F.filter(splitlines(text), lambda x: strip(x) != ""), source)


#: A mark that no source holds.
_MARK = "\ue000"
_NUMBER, _VARIABLE = r"^([0-9]{1,4})\+?(?= |$)", r"\b([iyc][0-9]+)\b"


def alpha_normalise(text) -> Column:
    """Source with statement numbers and variables renamed by their rank among the first appearances of their kind; headers stay.

    A name's rank is its place in the distinct names of the text in order, so
    the whole renaming is one expression.
    """

    def line(x):
        return F.struct(x.startswith("+").alias("head"), F.when(x.startswith("+"), x).otherwise(F.array_join(words(x), " ")).alias("text"))

    def rename(lines):
        plain = F.transform(F.filter(lines, lambda x: ~x["head"]), lambda x: x["text"])
        numbers = F.array_distinct(F.filter(F.transform(plain, lambda x: F.regexp_extract(x, _NUMBER, 1)), lambda n: n != ""))
        bare = F.transform(plain, lambda x: F.regexp_replace(x, _NUMBER, ""))
        names = F.array_distinct(F.regexp_extract_all(F.array_join(bare, "\n"), F.lit(_VARIABLE), F.lit(1)))
        ranks = F.struct(numbers.alias("s"), *(of_kind(names, k).alias(k) for k in "iyc"))
        return bind(ranks, lambda r: F.array_join(F.transform(lines, lambda x: F.when(x["head"], x["text"]).otherwise(renamed(x["text"], r))), "\n"))

    def of_kind(names, kind):
        return F.filter(names, lambda v: v.startswith(kind))

    def renamed(x, r):
        number = F.regexp_extract(x, _NUMBER, 1)
        head = F.when(number != "", F.format_string("%04d+", F.array_position(r["s"], number))).otherwise("")
        parts = F.split(F.regexp_replace(F.regexp_replace(x, _NUMBER, ""), _VARIABLE, f"{_MARK}$1{_MARK}"), _MARK)
        place = lambda p: F.coalesce(*(F.nullif(F.array_position(r[k], p), F.lit(0)) for k in "iyc"))
        return F.concat(head, F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.left(p, F.lit(1)), place(p).cast("string"))).otherwise(p)), ""))

    return F.concat(bind(F.transform(splitlines(text), line), rename), F.lit("\n"))


def shape_normalise(text) -> Column:
    """Source with statement numbers, variables, floats and integers masked."""

    def mask(line):
        s = single_spaced(line)
        s = F.regexp_replace(s, r"^\d{1,4}\+?(?= |$)", "stmt+")
        s = F.regexp_replace(s, r"\b[iyc]\d+\b", "var")
        s = F.regexp_replace(s, r"\b\d+j\b", "float")
        return F.when(line.startswith("+"), F.lit("+ header")).otherwise(F.regexp_replace(s, r"\b\d+\b", "int"))

    return F.concat(F.array_join(F.transform(splitlines(text), mask), "\n"), F.lit("\n"))


def statement_count(text) -> Column:
    """Lines that are neither blank nor start with ``+``."""
    return F.size(F.filter(splitlines(text), lambda x: (strip(x) != "") & ~x.startswith("+")))


def count_bucket(n, edges=((3, "1_3"), (8, "4_8"), (20, "9_20")), above: str = "21_plus") -> Column:
    """Name of the first bucket whose upper edge is not below n."""
    n, out = _col(n), None
    for edge, name in edges:
        out = F.when(n <= edge, name) if out is None else out.when(n <= edge, name)
    return out.otherwise(above)


# -- prompts and completions ----------------------------------------------------------------------------------------

#: Tags and turns of the prompt format (fixed values).
SOURCE_OPEN, SOURCE_CLOSE, DECK_OPEN, DECK_CLOSE = "<IT>", "</IT>", "<PIT>", "</PIT>"


def source_block(source) -> Column:
    return F.concat(F.lit(f"{SOURCE_OPEN}\n"), rstrip(source), F.lit(f"\n{SOURCE_CLOSE}"))


def _strip_newlines(c) -> Column:
    return F.regexp_replace(c, r"^\n+|\n+\z", "")


def wrap_completion(deck) -> Column:
    return F.concat(F.lit(f"{DECK_OPEN}\n"), _strip_newlines(_col(deck)), F.lit(f"\n{DECK_CLOSE}"))


def ensure_wrapped(deck) -> Column:
    """The deck in its tags; one that has them already is only stripped."""
    s = strip(deck)
    return F.when(s.startswith(DECK_OPEN) & s.endswith(DECK_CLOSE), s).otherwise(wrap_completion(deck))


def prompt(source, system: str) -> Column:
    return F.concat(F.lit(f"{system}\n\nUser:\n"), source_block(source), F.lit("\n\nAssistant:\n"))


def few_shot_prompt(source, examples, system: str) -> Column:
    """``examples``: array of struct(source_text, completion)."""
    shots = F.transform(
        _col(examples),
        lambda e: F.concat(F.lit("User:\n"), source_block(e["source_text"]), F.lit("\n\nAssistant:\n"), ensure_wrapped(e["completion"]), F.lit("\n")),
    )
    tail = F.concat(F.lit("User:\n"), source_block(source), F.lit("\n"))
    return F.array_join(F.concat(F.array(F.lit(system), F.lit("")), shots, F.array(tail, F.lit("Assistant:\n"))), "\n")


def chat_messages(source, system: str, examples=None) -> Column:
    """array of struct(role, content), examples as user and assistant turns."""

    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    head, last = F.array(turn("system", F.lit(system))), F.array(turn("user", source_block(source)))
    if examples is None:
        return F.concat(head, last)
    shots = F.flatten(F.transform(_col(examples), lambda e: F.array(turn("user", source_block(e["source_text"])), turn("assistant", ensure_wrapped(e["completion"])))))
    return F.concat(head, shots, last)


def completion_deck(completion) -> Column:
    """The deck of a completion: between its tags, or all after an opening tag that is never closed, or all."""
    s = strip(completion)
    closed = rf"(?s){DECK_OPEN}\n?(.*?)\n?{DECK_CLOSE}"
    opened = F.regexp_replace(F.substring(s, len(DECK_OPEN) + 1, 1 << 30), r"^\n+", "")
    body = F.when(s.rlike(closed), F.regexp_extract(s, closed, 1)).when(s.startswith(DECK_OPEN), opened).otherwise(s)
    return _strip_newlines(F.substring_index(body, DECK_CLOSE, 1))


def thinking_trace(completion) -> Column:
    """What stands before the deck's opening tag; empty without one."""
    s = strip(completion)
    return F.when(s.contains(DECK_OPEN), rstrip(F.substring_index(s, DECK_OPEN, 1))).otherwise(F.lit(""))


def source_of_prompt(text) -> Column:
    """The source inside a prompt's tags, null without them."""
    body = rf"(?s){SOURCE_OPEN}\n(.*?)\n{SOURCE_CLOSE}"
    return F.when(_col(text).rlike(body), F.regexp_extract(_col(text), body, 1))


def signed_accumulator(text) -> Column:
    """``123-`` as -123, ``123+`` and ``123`` as 123, null for anything else."""
    s = strip(text)
    n = F.regexp_extract(s, r"^(\d+)[+-]?$", 1)
    return F.when(s.rlike(r"^\d+[+-]?$"), F.when(s.endswith("-"), -n.try_cast("long")).otherwise(n.try_cast("long")))


def last_progress(text, tail: int = 250) -> Column:
    """struct(done, total) of the last ``n/m`` among the last lines of a log, null without one."""
    lines = splitlines(text)
    hits = F.filter(F.slice(lines, F.greatest(F.size(lines) - tail + 1, F.lit(1)), tail), lambda x: x.rlike(r"\d+/\d+"))
    found = F.try_element_at(F.regexp_extract_all(F.try_element_at(hits, F.lit(-1)), F.lit(r"(\d+/\d+)"), F.lit(1)), F.lit(-1))
    return F.when(found.isNotNull(), F.struct(F.split(found, "/")[0].try_cast("long").alias("done"), F.split(found, "/")[1].try_cast("long").alias("total")))


def drop_one_line(text) -> Column:
    """Shrink candidates: the text's lines without one interior line each."""
    lines = splitlines(text)
    n = F.size(lines)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.concat(F.slice(lines, 1, i - 1), F.slice(lines, i + 1, F.greatest(n - i, F.lit(0)))))).otherwise(F.array().cast("array<array<string>>"))


def token_labels(prompt_tokens, completion_tokens, longest: int) -> Column:
    """struct(input_ids, attention_mask, labels): prompt labels are -100, all cut to ``longest``."""
    p, c = _col(prompt_tokens), _col(completion_tokens)
    ids = F.slice(F.concat(p, c), 1, longest)
    labels = F.slice(F.concat(F.transform(p, lambda _: F.lit(-100)), c), 1, longest)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"))


def trainable(labels) -> Column:
    """Whether any label is left after the cut that is not masked."""
    return F.exists(_col(labels), lambda x: x != -100)


def symbolic_location(card) -> Column:
    """The four digits before a card's last three fields of digits, as a number, else null."""
    found = F.regexp_extract(_col(card), r"\b(\d{4})\s+[\d\-]{2}\s+\d{4}\s+\d{4}\s*$", 1)
    return F.when(found != "", found.cast("int"))


def rate_slug(value: float) -> str:
    """A rate as part of a file name: 0.0002 is 0p0002, 1e-05 is 1em05."""
    return f"{value:g}".translate(str.maketrans(".-", "pm"))


def parsed(json_text) -> Column:
    """JSON as a variant, null for text that is none."""
    return F.try_parse_json(_col(json_text))
