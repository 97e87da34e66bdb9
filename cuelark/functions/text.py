"""Column functions on times, texts, speakers and labels.

White space is the Unicode kind throughout (the ideographic space too), and both the two characters `\\N` and a
real line end part the lines of a cue.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bidirectional controls with the byte order mark, lyric marks.
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\ufeff"
LYRIC = "♪♫♬"


# times ----------------------------------------------------------------------------------------------------


def srt_time(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm; negative counts as 0."""
    x = F.greatest(ms, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(x / 3600000), F.floor(x / 60000) % 60, F.floor(x / 1000) % 60, x % 1000)


def srt_ms(c: Column) -> Column:
    """HH:MM:SS,mmm as milliseconds; null if it is not one."""
    g = [F.regexp_extract(F.trim(c), r"^(\d+):(\d{2}):(\d{2}),(\d{3})$", i) for i in range(1, 5)]
    return F.when(g[0] != "", g[0].try_cast("long") * 3600000 + g[1].try_cast("long") * 60000 + g[2].try_cast("long") * 1000 + g[3].try_cast("long"))


def ass_time(ms: Column) -> Column:
    """Milliseconds as H:MM:SS.cc, rounded to hundredths half-even."""
    cs = F.bround(ms / 10).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def ass_ms(c: Column) -> Column:
    """H:MM:SS.cc as milliseconds; null if it is not one."""
    g = [F.regexp_extract(F.trim(c), r"^(\d+):(\d+):(\d+(?:\.\d*)?)$", i) for i in range(1, 4)]
    return F.when(g[0] != "", (g[0].try_cast("long") * 3600 + g[1].try_cast("long") * 60) * 1000 + F.round(g[2].try_cast("double") * 1000).cast("long"))


# texts ----------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def plain_text(c: Column) -> Column:
    """White space run together to single spaces, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def shown_text(c: Column) -> Column:
    """A cue's text on one line: \\N becomes a slash, white space runs together."""
    return plain_text(F.replace(c, F.lit("\\N"), F.lit(" / ")))


def cue_lines(c: Column) -> Column:
    return F.split(c, r"\\N|\n")


def drop_overrides(c: Column) -> Column:
    return F.regexp_replace(c, r"\{[^}]*\}", "")


def clean_text(c: Column) -> Column:
    """Overrides and control characters out, \\h to a space, lyric lines out, lines trimmed and joined by \\N."""
    plain = F.translate(drop_overrides(c), BIDI, "")
    plain = F.replace(plain, F.lit("\\h"), F.lit(" "))
    kept = F.filter(F.transform(cue_lines(plain), strip), lambda x: (x != "") & ~x.rlike(rf"^[~ \u3000]*[{LYRIC}]"))
    return F.array_join(kept, "\\N")


def norm_speaker(c: Column, depth: int = 4) -> Column:
    """Speaker token without bidi characters and bracketed readings; brackets nested deeper than `depth` keep their rest."""
    x = F.translate(c, BIDI, "")
    # fixed value: an innermost pair, that is an opening bracket, no bracket of either kind, a closing one
    inner = "[(（][^(（)）]*[)）]"
    for _ in range(depth):
        x = F.regexp_replace(x, inner, "")
    return strip(x)


def nfkc_batch(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Spark has no NFKC; Arrow batches through the standard library."""
    return F.arrow_udf(nfkc_batch, T.StringType())(c)


def squeeze(c: Column) -> Column:
    """Text without \\N, line ends and any white space."""
    return F.regexp_replace(F.replace(c, F.lit("\\N"), F.lit("")), r"(?U)\s+", "")


def match_key(c: Column) -> Column:
    return squeeze(nfkc(c))


def short_text(key: Column, n: int = 5) -> Column:
    return F.char_length(key) <= n


def interjection(key: Column) -> Column:
    """Only kana, marks and the like, or a short text without ideographs, Latin letters and digits."""
    # Kana and marks that make an interjection.
    sounds = r"^[ぁ-んァ-ンーっッ~～…\.・!！?？、, ]{1,12}$"
    return key.rlike(sounds) | (short_text(key) & ~key.rlike(r"[一-龯A-Za-z0-9]"))


def safe_idx(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]+$"), c.try_cast("long"))


def file_name(start_ms: Column, speaker: Column, text: Column, ordinal: Column) -> Column:
    """0001_speaker_h-mm-ss.cc_first-sentence, safe for file systems; the ordinal has four digits at least."""
    bad = r"[\\/:*?\"<>|\r\n\t]+"
    blank = lambda c: F.when(c == "", "_").otherwise(c)
    who = F.substring(strip(F.regexp_replace(speaker, bad, "_")), 1, 30)
    first = F.split(text, " / ", 2)[0]
    what = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(first), r"(?U)\s+", "_"), bad, "_"), r"^_+|_+$", ""), 1, 20)
    return F.concat_ws("_", F.format_string("%04d", ordinal.cast("long")), blank(who), F.replace(ass_time(start_ms), F.lit(":"), F.lit("-")), blank(what))


def prompt_line(idx: Column, start_ms: Column, end_ms: Column, speaker: Column, text: Column, target: Column) -> Column:
    mark = F.when(target, F.lit(">> ")).otherwise(F.lit("   "))
    return F.concat(mark, F.format_string("#%d [%s-%s] [%s] %s", idx.cast("long"), srt_time(start_ms), srt_time(end_ms), speaker, F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/"))))


# The override tags that say what an event is, in either case.
ASS_FLAGS = {"drawing": r"(?i)\\p(?:bo)?[1-9]", "positioned": r"(?i)\\(?:pos|move)\(", "karaoke": r"(?i)\\k[fo]?\d", "top": r"(?i)\\an[789](?:\D|$)"}


def ass_flags(text: Column) -> dict[str, Column]:
    """Drawing, positioned, karaoke and top-aligned, by override tags."""
    return {name: text.rlike(pattern) for name, pattern in ASS_FLAGS.items()}


# labels ---------------------------------------------------------------------------------------------------


def prediction_label(c: Column, cast: Sequence[str], groups: Sequence[str] = ()) -> Column:
    x = strip(c)
    return F.when(x.startswith("NONSPEECH"), "NONSPEECH").when(x.isin(*cast, "?", "OTHER") | x.contains("&") | x.isin(*groups), x).otherwise("OTHER")


def gold_target(c: Column, cast: Sequence[str], groups: Sequence[str] = ()) -> tuple[Column, Column, Column]:
    """(target label, accepted labels, class): canonical, combination, other or nonspeech."""
    x = strip(c)
    parts = F.filter(F.transform(F.split(x, "&"), strip), lambda p: p.isin(*cast))
    both = F.array_union(parts, F.array(x, F.array_join(F.reverse(F.split(x, "&")), "&")))
    kind = F.when(x.startswith("NONSPEECH"), "nonspeech").when(x.isin(*cast), "canonical").when(x.contains("&") | x.isin(*groups), "combination").otherwise("other")
    target = F.when(kind == "nonspeech", "NONSPEECH").when(kind == "other", "OTHER").otherwise(x)
    accepted = F.when((kind == "combination") & x.contains("&"), both).when(kind == "combination", F.array(F.lit("OTHER"), x)).otherwise(F.array(target))
    return target, accepted, kind


# classes of raw cues --------------------------------------------------------------------------------------

# Brackets and dashes of both widths.
_OPEN, _CLOSE, _DASH = "(（", ")）", "-－─―‐"


def leading_speaker(line: str) -> tuple[str, str] | None:
    """(speaker, rest) of a line that begins with a bracketed name, dashes and control characters aside."""
    t = line.lstrip(BIDI + " ")
    while t[:1] and t[0] in _DASH:
        t = t[1:].lstrip(BIDI + " ")
    depth = 0
    for i, ch in enumerate(t):
        depth += (ch in _OPEN) - (ch in _CLOSE)
        if not depth:
            return (t[1:i], t[i + 1 :]) if i else None
    return None


def _spoken(text: str) -> bool:
    """Whether a text has a line that is not empty and no lyric."""
    return any(p and not p.lstrip(BIDI + " ~\u3000").startswith(tuple(LYRIC)) for p in (x.strip() for x in text.replace("\\N", "\n").split("\n")))


def classify(text: str | None) -> dict:
    """Kind of a raw cue (multi, single, nonspeech, unlabeled) and its (speaker, text) parts."""
    text = text or ""
    lines = text.lstrip(BIDI + " ").replace("\\N", "\n").split("\n")
    blocks: list[tuple[str, list[str]]] = []
    heads = [leading_speaker(x) for x in lines]
    for head, line in zip(heads, lines, strict=True):
        if head:
            blocks.append((head[0], [head[1].strip()]))
        elif blocks:
            blocks[-1][1].append(line.strip())
    parts = [(who, "\\N".join(x for x in said if x)) for who, said in blocks]
    valid = [p for p in parts if _spoken(p[1])]
    if len(lines) > 1 and len(valid) > 1:
        return {"kind": "multi", "parts": [{"raw": w, "text": t} for w, t in valid]}
    if len(lines) > 1 and len(parts) > 1 and len(valid) == 1:
        return {"kind": "single", "parts": [{"raw": valid[0][0], "text": valid[0][1]}]}
    whole = leading_speaker(text) if text.lstrip(BIDI + " ").strip()[:1] in tuple(_OPEN) else None
    if whole and not whole[1].strip():
        return {"kind": "nonspeech", "parts": []}
    first = leading_speaker(text)
    if first:
        return {"kind": "single", "parts": [{"raw": first[0], "text": first[1].strip()}]}
    if text.strip().lstrip(BIDI + " ~\u3000").startswith(tuple(LYRIC)):
        return {"kind": "nonspeech", "parts": []}
    for i, head in enumerate(heads):
        if head:
            rest = [x.strip() for x in [*lines[:i], head[1], *lines[i + 1 :]]]
            return {"kind": "single", "parts": [{"raw": head[0], "text": "\\N".join(x for x in rest if x)}]}
    return {"kind": "unlabeled", "parts": []}


CLASSIFIED = "struct<kind:string,parts:array<struct<raw:string,text:string>>>"
_PARTS = "array<struct<raw:string,text:string>>"
_BRACKETS = f"[{_OPEN}{_CLOSE}]"
#: What str.strip() takes off.
_BLANK = r"[\s\x1C-\x1F]"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"(?U)^{_BLANK}+", ""), f"(?U){_BLANK}+$", "")


def _leading(line: Column) -> Column:
    """leading_speaker as a struct (raw, rest), or null: a fold over the pieces between brackets, whose state is the depth, the place and where the depth first is 0 again."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        last = F.right(piece, F.lit(1))
        depth = acc["depth"] + F.when(last.isin(*_OPEN), 1).when(last.isin(*_CLOSE), -1).otherwise(0)
        at = acc["at"] + F.char_length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (depth == 0) & (at > 1), at).otherwise(acc["end"]).alias("end"))

    def found(t: Column) -> Column:
        at = lambda n: F.struct(F.substring(t, F.lit(2), n - 2).alias("raw"), F.substring(t, n + 1, F.char_length(t)).alias("rest"))
        folded = F.aggregate(F.split(t, f"(?<={_BRACKETS})"), zero, step, lambda acc: acc["end"])
        plain = F.regexp_extract(t, f"^[{_OPEN}][^{_OPEN}{_CLOSE}]*[{_CLOSE}]", 0)
        # most lines have no bracket in front, and most of the others no bracket within it: only the rest are folded
        return F.when(t.rlike(f"^{_BRACKETS}"), let(F.char_length(plain), lambda n: F.when(n > 0, at(n)).otherwise(let(folded, lambda n: F.when(n > 0, at(n))))))

    return let(F.regexp_replace(line, f"^[{BIDI} ]*(?:[{_DASH}][{BIDI} ]*)*", ""), found)


def _sounds(text: Column) -> Column:
    """Whether a text has a line that is not empty and no lyric."""
    return F.exists(F.split(F.replace(text, F.lit("\\N"), F.lit("\n")), "\n"), lambda x: let(_stripped(x), lambda p: (p != "") & ~p.rlike(f"^[{BIDI} ~\u3000]*[{LYRIC}]")))


def _said(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, _stripped), lambda x: x != ""), "\\N")


def classified(c: Column) -> Column:
    """classify in the JVM: kind of a raw cue (multi, single, nonspeech, unlabeled) and its (speaker, text) parts."""
    part = lambda raw, text: F.struct(raw.alias("raw"), text.alias("text"))
    of = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.array(*parts).cast(_PARTS).alias("parts"))

    def by_lines(text: Column, lines: Column, heads: Column) -> Column:
        n = F.size(lines)
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: heads[i].isNotNull())

        def from_blocks(at: Column) -> Column:
            # a block: its head's rest and the lines up to the next head
            upto = lambda k: F.coalesce(F.get(at, k + 1), n)
            parts = F.transform(at, lambda i, k: part(heads[i]["raw"], _said(F.concat(F.array(heads[i]["rest"]), F.slice(lines, i + 2, upto(k) - i - 1)))))
            return let(parts, lambda parts: let(F.filter(parts, lambda p: _sounds(p["text"])), lambda valid: verdict(at, parts, valid)))

        def verdict(at: Column, parts: Column, valid: Column) -> Column:
            several = n > 1
            first = lambda i: of("single", part(heads[i]["raw"], _said(F.concat(F.slice(lines, F.lit(1), i), F.array(heads[i]["rest"]), F.slice(lines, i + 2, n)))))
            opened = _stripped(F.regexp_replace(text, f"^[{BIDI} ]+", "")).rlike(f"^[{_OPEN}]")
            rest = lambda lead: (
                F.when(several & (F.size(valid) > 1), F.struct(F.lit("multi").alias("kind"), valid.cast(_PARTS).alias("parts")))
                .when(several & (F.size(parts) > 1) & (F.size(valid) == 1), F.struct(F.lit("single").alias("kind"), valid.cast(_PARTS).alias("parts")))
                .when(opened & lead.isNotNull() & (_stripped(lead["rest"]) == ""), of("nonspeech"))
                .when(lead.isNotNull(), of("single", part(lead["raw"], _stripped(lead["rest"]))))
                .when(_stripped(text).rlike(f"^[{BIDI} ~\u3000]*[{LYRIC}]"), of("nonspeech"))
                .when(F.size(at) > 0, let(at[0], first))
                .otherwise(of("unlabeled"))
            )
            return let(_leading(text), rest)

        return let(at, from_blocks)

    def run(text: Column) -> Column:
        lines = F.split(F.replace(F.regexp_replace(text, f"^[{BIDI} ]+", ""), F.lit("\\N"), F.lit("\n")), "\n")
        return let(lines, lambda lines: let(F.transform(lines, _leading), lambda heads: by_lines(text, lines, heads)))

    return let(F.coalesce(c, F.lit("")), run).cast(CLASSIFIED)