"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the retrieval tokens.
STOP = (
    "the", "and", "for", "that", "this", "with", "from", "not", "but", "are", "was", "were", "has", "have", "had",
    "its", "it", "is", "of", "to", "in", "on", "as", "at", "by", "an", "or", "be", "a", "no", "so", "if", "then",
    "der", "die", "das", "und", "ist", "mit", "von", "den", "dem", "des",
)

# Labelled credential patterns.
SECRETS = [
    ("bearer token", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{16,}"),
    ("credential assignment", r"(?i)\b(api[_-]?key|secret|password|passwd|token|client[_-]?secret)\b\s*[:=]\s*[^\s;]{6,}"),
    ("private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws access key id", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("azure sas token", r"(?i)(?:\?|&)sv=[^\s&]+(?:&[^\s]*)?&sig=[A-Za-z0-9%+/=_-]{16,}"),
    ("session cookie", r"(?i)\bcookie\b\s*[:=]\s*\S{16,}"),
    ("long opaque blob", r"[A-Za-z0-9+/]{200,}={0,2}"),
]

# Substitutions of log templating, in their order.
LOG_SUBSTITUTIONS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<TIME>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HASH>"),
    (r"(?<=[=:\s])/[\w./-]{4,}", "<PATH>"),
    (r"(?<![\w.])\d+\.\d+", "<F>"),
    (r"(?<!\w)\d+", "<N>"),
]


def tokens(text: Column) -> Column:
    """Lower-case words that start with a letter or digit, edge punctuation cut, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9_.\-]*"), F.lit(0))
    cut = F.transform(found, lambda t: F.btrim(t, F.lit(".-_")))
    return F.filter(cut, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP))


def token_set(text: Column, cap: int | None = 4000) -> Column:
    """Distinct runs of four or more letters and digits among the first ``cap``, or among all if that is None."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{4,}"), F.lit(0))
    return F.array_distinct(found if cap is None else F.slice(found, 1, cap))


def title_of(text: Column, fallback: Column) -> Column:
    """The ``title:`` line, else the first heading, else the fallback."""
    named = F.trim(F.regexp_extract(text, r"(?m)^title:\s*(.+)$", 1))
    heading = F.trim(F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+)$", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(heading, F.lit("")), fallback)


def slug(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))


def confidence_of(text: Column) -> Column:
    return F.regexp_extract(text, r"\*\*Confidence:\*\*\s*(VERIFIED|HIGH|MEDIUM|LOW)", 1)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4.0).cast("long"))


def snippet(text: Column, query: list[str], width: int = 110) -> Column:
    """The first line with a query token, white space collapsed, cut to width."""
    asked = F.array(*[F.lit(q) for q in query])
    lines = F.filter(F.split(text, "\n"), lambda line: F.arrays_overlap(tokens(line), asked))
    return F.left(F.trim(F.regexp_replace(F.get(lines, 0), r"\s+", " ")), F.lit(width))


# What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def lines_of(text: Column) -> Column:
    """The lines of a text; an end of line at the end of the text starts no other."""
    parts = F.split(text, LINE_END)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def head_tail(text: Column, head: int = 40, tail: int = 10, ref: str = "T1") -> Column:
    """First and last lines, the number of those between in their place; a short text as it is."""
    lines = lines_of(text)
    n = F.size(lines)
    middle = F.concat(F.lit("\n\n... ["), (n - head - tail).cast("string"), F.lit(f" lines elided, ref={ref}] ...\n\n"))
    cut = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), middle, F.array_join(F.slice(lines, -tail, tail), "\n"), F.lit("\n"))
    return F.when(n > head + tail, cut).otherwise(text)


def offsets(text: Column, pattern: str) -> Column:
    """Array of (start, match) of a pattern without groups: the pieces between the matches tell where these are."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    empty = F.expr("cast(array() as array<struct<start:int,match:string>>)")

    def add(done, m):
        k = F.size(done)
        before = F.when(k == 0, 0).otherwise(F.get(done, k - 1)["start"] + F.length(F.get(done, k - 1)["match"]))
        return F.concat(done, F.array(F.struct((before + F.length(F.get(between, k))).alias("start"), m.alias("match"))))

    return F.aggregate(found, empty, add)


def secret_hits(text: Column) -> Column:
    """Array of (label, start, match) of all credential patterns."""
    named = lambda label: lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start"), m["match"].alias("match"))
    return F.concat(*[F.transform(offsets(text, _bare(pattern)), named(label)) for label, pattern in SECRETS])


def _bare(pattern: str) -> str:
    """A pattern whose groups do not capture."""
    import re

    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clip(text: Column, width: int = 60) -> Column:
    """White space collapsed, cut to width with an ellipsis."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


def escape_cell(value: Column) -> Column:
    return F.trim(F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def strip_code(text: Column) -> Column:
    """Without fenced code, inline code, URLs and paths."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", ""), "`[^`]*`", "")
    return F.regexp_replace(bare, r"https?://\S+|/[-\w./]+", "")


def template(line: Column) -> Column:
    """A log line with its variable parts replaced by their kinds."""
    for pattern, kind in LOG_SUBSTITUTIONS:
        line = F.regexp_replace(line, pattern, kind)
    return line


def looks_like_log(text: Column, least: int = 20, first: int = 400, share: float = 0.6) -> Column:
    lines = F.slice(F.filter(lines_of(text), lambda line: F.trim(line) != ""), 1, first)
    return (F.size(lines) >= least) & (F.size(F.array_distinct(F.transform(lines, template))) <= share * F.size(lines))


def secrets(text: Column) -> Column:
    """Labels of the credential patterns found."""
    return F.filter(F.array(*[F.when(text.rlike(pattern), label) for label, pattern in SECRETS]), lambda x: x.isNotNull())


def glob_to_regex(pattern: str, crosses: bool = True) -> str:
    """A regular expression for a glob with ``*``, ``?``, ``[abc]`` and ``[!abc]``; a bracket that is not closed stands for itself.

    With ``crosses`` a star also matches slashes.  Without, it stays within a folder, and a step
    ``**`` stands for any number of folders, none included; as the last step for all below.
    """
    import re

    def one(token: str) -> str:
        if token[0] == "[" and len(token) > 1:
            body = re.sub(r"([\\\[&^])", r"\\\1", token[2 if token[1] == "!" else 1 : -1])
            return f"[{'^' if token[1] == '!' else ''}{body.replace(']', chr(92) + ']')}]" if crosses else f"(?!/)[{'^' if token[1] == '!' else ''}{body.replace(']', chr(92) + ']')}]"
        if token[0] == "*":
            return ".*" if crosses else "[^/]*"
        if token == "?":
            return "." if crosses else "[^/]"
        return re.escape(token)

    plain = lambda part: "".join(one(t) for t in re.findall(r"\*+|\?|\[!?\]?[^\]]*\]|.", part, re.DOTALL))
    if crosses:
        return rf"(?s)\A{plain(pattern)}\z"
    *steps, last = pattern.split("/")
    folders = "".join("(?:[^/]+/)*" if s == "**" else plain(s) + "/" for s in steps)
    return rf"(?s)\A{folders}{'.+' if last == '**' else plain(last)}\z"


def file_kind(path: Column, text: Column) -> Column:
    """How a file is digested: by its extension, else its first sign, else whether its lines repeat: json, code, csv, log or text.

    A JSON extension or sign counts only if the text, or each of its lines, parses.
    """
    code = [".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt"]
    extension = F.lower(F.regexp_extract(path, r"[^/]\.[^./]*$", 0))
    extension = F.regexp_extract(extension, r"\.[^./]*$", 0)
    return (
        F.when(extension.isin(".json", ".jsonl", ".ndjson") & parses(text), "json")
        .when(extension.isin(*code), "code")
        .when(extension.isin(".csv", ".tsv"), "csv")
        .when(F.ltrim(text).rlike(r"^[\[{]") & parses(text), "json")
        .when(looks_like_log(text), "log")
        .otherwise("text")
    )


def parses(text: Column) -> Column:
    """Whether a text is one JSON value, or its lines that are not blank are one each."""
    filled = F.filter(lines_of(text), lambda line: F.trim(line) != "")
    return F.coalesce(is_json(text) | ((F.size(filled) > 0) & F.forall(filled, is_json)), F.lit(False))


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value; as the only item of a list nothing may follow it."""
    item = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce((F.json_array_length(item) == 1) & F.try_parse_json(item).isNotNull(), F.lit(False))


def approx_ratio(digest: Column, original: Column) -> Column:
    """Characters of a digest for each of the original; 1 for an empty one."""
    return F.when(F.length(original) == 0, 1.0).otherwise(F.length(digest) / F.length(original))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its base: not absolute, and no step leads above the base."""
    steps = F.split(path, "/")
    move = lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, s: F.struct((a["at"] + move(s)).alias("at"), F.least(a["least"], a["at"] + move(s)).alias("least")))
    return ~F.startswith(path, F.lit("/")) & (depth["least"] >= 0)


def payload(content: Column, base64: Column) -> Column:
    """Bytes of an operation's content: base64 where given, else the text in UTF-8, else null."""
    return F.when(base64.isNotNull(), F.try_to_binary(base64, F.lit("base64"))).otherwise(F.encode(content, "UTF-8"))
