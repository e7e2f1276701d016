"""Generated, minified, vendored files and data saved as code, by belief propagation over directory trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add, eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.operators.dedup import one_per_key
from strataseek.operators.skew import join_facts
from strataseek.runtime import materialise

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

# Extensions of program and configuration text, and names of lock files.
_CODE_EXT = (
    "py pyi js jsx mjs cjs ts tsx go java kt kts scala groovy c h cc cpp cxx hpp cs rs rb php pl pm lua r jl swift m mm dart ex exs erl hs ml fs vb sql sh bash zsh ps1 bat cmd css scss sass less vue svelte "
    "json json5 yaml yml toml ini cfg conf properties xml gradle cmake mk tf proto graphql ipynb lock sum"
)
_LOCK = r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|bun\.lockb?|go\.sum|[^/]*\.lock)$"
_GENERATED_NAME = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|_pb(?:_service)?\.(?:d\.)?[jt]s|\.generated\.\w+|[._-]gen\.\w+|_generated\.\w+|\.g\.(?:dart|cs)|\.designer\.cs|(?:^|/)zz_generated[^/]*|(?:^|/)autogen_[^/]*)$"
_MINIFIED_NAME = r"(?:[.-]min\.\w+|\.bundle\.\w+|\.chunk\.\w+|[.-][0-9a-f]{8,32}\.(?:js|css|mjs))$"
_VENDORED_NAME = r"(?:^|/)[a-z][\w-]*-\d+\.\d+(?:\.\d+)?\.\w+$"
_GENERATED_DIR = r"^(?:gen|generated|__generated__|_generated|autogen|auto_generated|codegen_out)$"
_VENDORED_DIR = r"^(?:vendor|vendored|third[_-]?party|extern|externals?|node_modules|bower_components|site-packages|_vendor)$|-\d+\.\d+(?:\.\d+)?$"
_GENERATED_TEXT = (
    r"(?i)code generated by\b.{0,80}do not edit|@generated\b|<auto-?generated|\bauto-?generated\b.{0,80}(?:edit|modif|chang|regenerat|do not)|\bautomatically (?:generated|produced|created) (?:by|from|with)\b"
    r"|\bmachine-(?:written|generated|made) by\b|\b(?:file|code) (?:is|was) (?:auto-?)?generated\b|\bgenerated (?:by|from)\b.{0,80}(?:do not|don't|never) (?:edit|modify|change)"
    r"|généré automatiquement|automatisch (?:generiert|erzeugt|erstellt)|generado automáticamente|gerado automaticamente|自动生成|自動生成"
)
_VENDORED_TEXT = (
    r"(?i)\(c\) (?:the )?[\w .-]{1,40}authors\b|\bupstream (?:release|repository|version)\b|\bpart of the [\w .-]{1,40} project, version\b|\bcopyright (?:\(c\) )?\d{4}(?:-\d{4})? [\w .-]{1,40}contributors\b"
    r"|\bredistribution (?:and use|permitted)\b|\breleased under the [\w .-]{1,30} licen[cs]e\b|\blicensed under the (?:mit|apache|bsd|mozilla|isc|gnu)\b|/\*! [\w.-]+ v?\d+\.\d+|@license\b"
)
_OWN_TEXT = r"(?i)\bcopyright (?:\(c\) )?\d{4}(?:-\d{4})? the [\w .-]{1,40} team\b|\binternal use\b|\ball rights reserved by\b"
#: Code that writes or looks for such notices quotes them.
_QUOTES_TEXT = r"(?i)[\"'`](?:do not edit|code generated|@generated|auto-?generated)\b[^\"'`\n]{0,60}[\"'`]"
#: One of these stands in every notice; texts without them need no closer look.
_HINTS = {
    "generated": ("generated", "automatically", "machine-", "généré", "automatisch", "generado", "gerado", "自动生成", "自動生成"),
    "vendored": ("authors", "upstream", "part of the", "contributors", "redistribution", "licen", "/*!"),
    "own": ("copyright", "internal use", "all rights"),
    "quotes": ("do not edit", "code generated", "@generated", "autogenerated", "auto-generated"),
}
_NOTICES = {k: re.compile(rx) for k, rx in (("generated", _GENERATED_TEXT), ("vendored", _VENDORED_TEXT), ("own", _OWN_TEXT), ("quotes", _QUOTES_TEXT))}

# Evidence in log-odds against nothing known.
ORDINARY, UNKNOWN, OWN, QUOTES = 2.0, 0.5, 4.0, 6.0
NOTICE, STEADY, DENSE, DATA, LOCK, NAME, FOLDER, PLAIN_FOLDER = 12.0, 9.0, 9.0, 10.0, 14.0, 8.0, 20.0, 1.2
#: How often a file has the label of its directory, by label of the directory; the other labels share the rest. Third-party
#: and generated folders hold little else, one minified file or data blob says little about its neighbours.
FILE_SAME = {"handwritten": 0.8, "generated": 0.95, "minified": 0.6, "vendored": 0.9, "blob": 0.4}
#: The same for a directory and its parent.
DIR_SAME = {"handwritten": 0.99, "generated": 0.97, "minified": 0.9, "vendored": 0.97, "blob": 0.9}
#: Directories below this depth count as their ancestor at it.
MAX_DEPTH = 32
_COLS = [f"w_{x}" for x in LABELS]


def _basename_parts(path: Column) -> tuple[Column, Column]:
    clean = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+|/+$", ""))
    return clean, F.regexp_extract(clean, r"^(.*?)/?[^/]*$", 1)


def is_code(path: Column) -> Column:
    """Whether a path names program or configuration text."""
    clean, _ = _basename_parts(path)
    return clean.rlike(r"\.(?:" + "|".join(_CODE_EXT.split()) + r")$") & ~clean.rlike(r"\.(?:pem|key|csv|tsv|jsonl)$")


_RUN = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|(?:\\x[0-9a-fA-F]{2}){10,}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
_WORDS = re.compile(r"[^\W\d]\w*|-?\d[\d.]*")
_SUMS = ("n_chars", "n_lines", "n_space", "n_digit", "n_literal", "n_same")
_MAXIMA = ("longest", "says_generated", "says_vendored", "says_own", "says_quotes")


def describe(text: str) -> tuple[int, ...]:
    """_SUMS and _MAXIMA of one text; key blocks are left aside.

    Characters, lines that are not blank, white space, digits, characters of
    long unbroken literals (filler aside), lines shaped like the
    line before, the longest line (filler aside), and flags for notices of generators, of third parties, of
    the project itself, and for notices in quotes.
    """
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    low = t.lower()
    bare = _PEM.sub("", t) if "-----BEGIN" in t else t
    raw = bare.encode("utf-8", "replace")
    literal = 0
    for m in _RUN.finditer(bare):
        run = m.group(0)
        if len(set(run)) > 8 or run[0] == "\\":
            literal += len(run)
    rows = bare.split("\n")
    longest = max(len(x) if len(x) < 200 or len(set(x)) > 10 else 0 for x in rows)  # filler is not code
    shapes = [y for x in _WORDS.sub("a", _QUOTED.sub("q", bare)).split("\n") if (y := x.strip())]
    same = sum(map(eq, shapes, shapes[1:]))
    says = [int(any(h in low for h in _HINTS[k]) and _NOTICES[k].search(t) is not None) for k in _NOTICES]
    return (len(bare), sum(not x.isspace() for x in rows if x), len(raw) - len(raw.translate(None, b" \t\n\r\f\v")), len(raw) - len(raw.translate(None, b"0123456789")), literal, same, longest, *says)


def text_evidence(chunks: DataFrame) -> DataFrame:
    """What the chunks of a code file say, per file_id: sums and maxima of ``describe`` over its chunks.

    Computed on whole contents next to the scan; only numbers are shuffled. Of
    different rows of a chunk id the greatest by its numbers counts.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [*zip(*map(describe, batch.column("content").to_pylist()), strict=True)] or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("file_id"), *(pa.array(v, pa.int64()) for v in values)], names=["id", "file_id", *names])

    names = [*_SUMS, *_MAXIMA]
    c = chunks.where(is_code(F.col("rel_path")) & F.col("content").isNotNull()).select("id", "file_id", "content")
    kinds = dict(c.dtypes)
    f = c.mapInArrow(measure, f"id {kinds['id']}, file_id {kinds['file_id']}, " + ", ".join(f"{x} long" for x in names))
    f = f.groupBy("id").agg(F.max(F.struct("file_id", *names)).alias("x")).select("x.*")
    return f.groupBy("file_id").agg(*(F.sum(x).alias(x) for x in _SUMS), *(F.max(x).alias(x) for x in _MAXIMA))


def file_evidence(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Log-potentials of each label per file: file_id, project_id, dir, eligible, w_handwritten ... w_blob."""
    f = one_per_key(files.select("id", "project_id", "rel_path"), "id").where("id IS NOT NULL")
    clean, folder = _basename_parts(F.coalesce("rel_path", F.lit("")))
    f = f.select(F.col("id").alias("file_id"), F.coalesce("project_id", F.lit("")).alias("project_id"), clean.alias("path"), folder.alias("dir"), is_code(F.coalesce("rel_path", F.lit(""))).alias("eligible"))
    t = f.join(text_evidence(chunks), "file_id", "left")
    p = F.col("path")
    hit = lambda cond, w: F.when(cond, F.lit(w)).otherwise(0.0)
    has = F.col("n_chars") > 0
    says = lambda x: F.coalesce(F.col(f"says_{x}"), F.lit(0)) == 1
    program = ~p.rlike(r"\.(?:json5?|ipynb|ya?ml|toml|ini|cfg|conf|properties|xml|lock)$")
    steady = has & (F.col("n_lines") >= 5) & (F.col("n_same") >= 0.8 * (F.col("n_lines") - 1)) & program
    digits = F.try_divide("n_digit", "n_chars")
    literal = has & (F.col("n_literal") >= 0.5 * F.col("n_chars"))
    rows = (steady & (digits >= 0.14)) | (has & (digits >= 0.3) & program)
    dense = has & (F.col("longest") >= F.when(program, 200).otherwise(500)) & (F.col("n_space") < 0.07 * F.col("n_chars")) & (F.col("n_literal") < 0.5 * F.col("n_chars")) & ~rows
    made, taken, own, quotes = says("generated"), says("vendored"), says("own"), says("quotes")
    odd = F.coalesce(made | taken | literal | rows | steady | dense, F.lit(False))
    return t.select(
        "file_id", "project_id", "dir", "eligible",
        (hit(has & ~odd, ORDINARY) + hit(own & ~made, OWN) + hit(quotes & ~made, QUOTES) + UNKNOWN).alias("w_handwritten"),
        (hit(p.rlike(_LOCK), LOCK) + hit(p.rlike(_GENERATED_NAME), NAME) + hit(made, NOTICE) + hit(steady & ~rows, STEADY)).alias("w_generated"),
        (hit(p.rlike(_MINIFIED_NAME), NAME) + hit(dense, DENSE)).alias("w_minified"),
        (hit(p.rlike(_VENDORED_NAME), NAME) + hit(taken & ~own, NOTICE)).alias("w_vendored"),
        (hit(literal, DATA) + hit(rows, DATA)).alias("w_blob"),
    )


def compatibility(same: dict[str, float]) -> list[list[float]]:
    """P(label of the child | label of the parent), a row per label of the parent."""
    k = len(LABELS)
    return [[same[y] if x == y else (1 - same[y]) / (k - 1) for x in LABELS] for y in LABELS]


def _with_messages(df: DataFrame, psi: list[list[float]], cols: list[str], out: list[str]) -> DataFrame:
    """Adds sum-product messages: out[i] = log sum_j psi[i][j] exp(cols[j]), relative to the first.

    In steps of plain columns, so that no step repeats the expressions of the one before.
    """
    df = df.withColumn("__top", F.greatest(*cols))
    df = df.withColumns({f"__e{i}": F.exp(F.col(c) - F.col("__top")) for i, c in enumerate(cols)})
    df = df.withColumns({f"__l{i}": F.log(reduce(add, (F.col(f"__e{j}") * w for j, w in enumerate(row)))) for i, row in enumerate(psi)})
    df = df.withColumns({o: F.col(f"__l{i}") - F.col("__l0") for i, o in enumerate(out)})
    return df.drop("__top", *(f"__{x}{i}" for x in "el" for i in range(len(cols))))


def _directory_evidence(name: Column) -> list[Column]:
    zero = F.lit(0.0)
    named = name.rlike(_GENERATED_DIR) | name.rlike(_VENDORED_DIR)
    return [F.when(named, zero).otherwise(PLAIN_FOLDER), F.when(name.rlike(_GENERATED_DIR), FOLDER).otherwise(zero), zero, F.when(name.rlike(_VENDORED_DIR), FOLDER).otherwise(zero), zero]


def propagate(evidence: DataFrame) -> DataFrame:
    """Beliefs of files after one exact pass up and down each directory tree: adds b_handwritten ... b_blob (logs).

    ``evidence``: as from ``file_evidence``. A tree is a project; its nodes
    are directories and files. Messages of the children are summed per
    directory with partial sums on the map side, level by level from the
    deepest; on the way down each node gets what the others know. The number
    of passes is the depth of the deepest path, at most MAX_DEPTH. A directory that holds a large
    part of all files meets its files by broadcast.
    """
    # Filters are pushed through projections by repeating their expressions, so each message is written before it is used.
    sent_cols, rest_cols, down_cols = ([f"{p}_{x}" for x in LABELS] for p in ("m", "r", "d"))
    up_file, up_dir = compatibility(FILE_SAME), compatibility(DIR_SAME)
    down_file, down_dir = ([list(c) for c in zip(*m, strict=True)] for m in (up_file, up_dir))
    e = evidence.withColumn("dir", F.substring_index("dir", "/", MAX_DEPTH))
    e = e.withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))))
    e = materialise(_with_messages(e, up_file, _COLS, sent_cols))
    key = ["project_id", "dir"]
    deepest = e.agg(F.max("depth")).first()[0]
    if deepest is None:
        return e.select(*evidence.columns, *(F.lit(0.0).alias(f"b_{x}") for x in LABELS))
    leaf = e.select(*key, "depth", F.lit(1).cast("long").alias("n_files"), *(F.col(m).alias(c) for c, m in zip(_COLS, sent_cols, strict=True)))
    leaf = materialise(leaf.groupBy(*key, "depth").agg(F.sum("n_files").alias("n_files"), *(F.sum(c).alias(c) for c in _COLS)))
    up: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):
        below = leaf.where(F.col("depth") == d).select(*key, "n_files", *_COLS)
        if d < deepest:
            parent = F.when(F.instr("dir", "/") > 0, F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)).otherwise("")
            sent = up[d + 1].select("project_id", parent.alias("dir"), F.lit(0).cast("long").alias("n_files"), *(F.col(f"m_{x}").alias(f"w_{x}") for x in LABELS))
            below = below.unionByName(sent)
        node = below.groupBy(*key).agg(F.sum("n_files").alias("n_files"), *(F.sum(c).alias(c) for c in _COLS))
        name = F.regexp_extract("dir", r"([^/]*)$", 1)
        node = node.select(*key, "n_files", *((F.col(c) + x).alias(c) for c, x in zip(_COLS, _directory_evidence(name), strict=True)))
        up[d] = materialise(_with_messages(node, up_dir, _COLS, sent_cols))
    beliefs = up[0].select(*key, "n_files", *_COLS)
    done = [beliefs]
    for d in range(1, deepest + 1):
        parent = F.when(F.instr("dir", "/") > 0, F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)).otherwise("")
        above = beliefs.select("project_id", F.col("dir").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in _COLS))
        rows = up[d].withColumn("parent", parent).join(above, ["project_id", "parent"])
        rows = rows.withColumns({r: F.col(f"p_{c}") - F.col(m) for r, c, m in zip(rest_cols, _COLS, sent_cols, strict=True)})
        rows = _with_messages(rows, down_dir, rest_cols, down_cols)
        beliefs = materialise(rows.select(*key, "n_files", *((F.col(c) + F.col(m)).alias(c) for c, m in zip(_COLS, down_cols, strict=True))))
        done.append(beliefs)
    dirs = done[0]
    for b in done[1:]:
        dirs = dirs.unionByName(b)
    dirs = materialise(dirs.select(*key, "n_files", *(F.col(c).alias(f"p_{c}") for c in _COLS)))
    joined = join_facts(e.drop("depth"), dirs, key, "n_files", e.count())
    joined = joined.withColumns({r: F.col(f"p_{c}") - F.col(m) for r, c, m in zip(rest_cols, _COLS, sent_cols, strict=True)})
    joined = _with_messages(joined, down_file, rest_cols, down_cols)
    return materialise(joined.select(*evidence.columns, *((F.col(c) + F.col(m)).alias(f"b_{x}") for x, c, m in zip(LABELS, _COLS, down_cols, strict=True))))


def label_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, label, p_handwritten of every file of program or configuration text, one row per id.

    ``files``: id, project_id, rel_path; ``chunks``: id, file_id, rel_path,
    content. A file without chunks is judged by its path and its directory.
    Null ids are left out, a null project is one of its own, a null path is no
    code; repeated rows count once (of different rows of an id the greatest);
    other columns are ignored; no files give no rows.
    """
    b = propagate(file_evidence(files, chunks)).where("eligible").select("file_id", *(f"b_{x}" for x in LABELS))
    b = b.withColumn("__top", F.greatest(*(f"b_{x}" for x in LABELS)))
    label = F.coalesce(*(F.when(F.col(f"b_{x}") == F.col("__top"), x) for x in LABELS))
    total = sum((F.exp(F.col(f"b_{x}") - F.col("__top")) for x in LABELS[1:]), F.exp(F.col(f"b_{LABELS[0]}") - F.col("__top")))
    return materialise(b.select("file_id", label.alias("label"), F.round(F.exp(F.col(f"b_{LABELS[0]}") - F.col("__top")) / total, 6).alias("p_handwritten")))
