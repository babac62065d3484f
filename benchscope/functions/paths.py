"""Path and text expressions of the ingest (B1-B9), as Spark Columns.

Paths are absolute POSIX strings (``/a/b/file``).  ``D(k)`` is the k-th
ancestor directory of a file (``D(1)`` is its own directory), following
``os.path.dirname``: the ancestor of ``/`` is ``/``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour ------------------
RUN_DIR_PREFIXES = ("out_", "out-")
BACKEND_TIMESTAMP_RE = r"^out[_-]([^_-]+)[_-](\d+)"
DATASET_RE = r"dataset_generator-(\w+)_dataset_name-(\w+)"
METRIC_RE = r"metric-(\w+)"
METHOD_SEED_RE = r"method-(.+?)_seed-(\d+)"
LINKAGE_SEED_RE = r"linkage-(.+?)_seed-(\d+)"
LINKAGE_LIBRARIES = ("agglomerative", "fastcluster", "sklearn")
DATASET_TOKENS = ("dataset_generator-", "dataset_name-")
METHOD_TOKEN = "method-"
K_FALLBACK = 999999
# ---------------------------------------------------------------------------

# Python's float() syntax (digits may be grouped with single underscores).
_DIGITS = r"\d(?:_?\d)*"
PY_FLOAT_RE = (rf"^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$")
PY_SPECIAL_RE = r"(?i)^\s*[+-]?(?:inf|infinity|nan)\s*$"
PY_INT_RE = rf"^\s*[+-]?{_DIGITS}\s*$"
#: What nearly every number looks like; the general rules above are tried only beyond it.
PLAIN_NUMBER_RE = r"^-?[0-9]+(?:\.[0-9]+)?$"
#: What ends a line in Java's regexes.
LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")


def _u(pattern: str) -> str:
    """Python 3's ``\\w``/``\\d`` are Unicode-aware; so is Java's with (?U)."""
    return "(?U)" + pattern


def parts(path: Column) -> Column:
    return F.split(path, "/")


def ancestor(path: Column, k: int | Column, split: Column | None = None) -> Column:
    """``D(k)``: the k-th ancestor directory of ``path`` (``/`` at most).

    For a fixed ``k`` this is string arithmetic (cut the last k components
    with ``substring_index``), no array is built; a column ``k`` uses the
    split path (``split`` may pass a precomputed ``parts(path)``).
    """
    if isinstance(k, int):
        tail = F.substring_index(path, "/", -k)
        cut = F.left(path, F.length(path) - F.length(tail) - F.lit(1))
        return F.when(cut == "", F.lit("/")).otherwise(cut)
    p = split if split is not None else parts(path)
    n = F.size(p) - k
    joined = F.array_join(F.slice(p, 1, F.greatest(n, F.lit(1))), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def nearest_dir(path: Column, name_re: str, token: str, first: int, last: int) -> Column:
    """The nearest of the directories ``first`` to ``last`` levels above ``path`` (0: the path
    itself) whose name matches ``name_re``, which contains ``token``; NULL if none does.

    One regex: the greedy prefix makes the match the deepest one, the repeat bound keeps it
    within the levels.  Only paths with the token are matched.
    """
    pattern = rf"^(.*/{name_re})(?:/[^/]+){{{first},{last}}}$"
    return F.when(path.contains(token), F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")))


def is_plain(path: Column) -> Column:
    """Whether a path is absolute, without empty names and without line ends, as nearly all are:
    the string arithmetic below agrees with the regexes on these."""
    odd = reduce(or_, [path.contains(x) for x in ("//", *LINE_ENDS)])
    return path.startswith("/") & ~path.endswith("/") & ~odd


def _last_named(path: Column, token: str) -> tuple[Column, Column, Column]:
    """(dir, levels, head) by the last place of ``token`` in a plain path that has it: the directory
    whose name it is in, how many levels up that is (0: it is in the file's own name), and the
    path up to the token's end."""
    tail = F.substring_index(path, token, -1)
    slash = F.instr(tail, "/")
    head = F.left(path, F.length(path) - F.length(tail))
    levels = F.length(tail) - F.length(F.replace(tail, F.lit("/"), F.lit("")))
    return F.left(path, F.length(path) - F.length(tail) + slash - 1), levels, head


def method_dir(path: Column, last: int) -> Column:
    """The nearest directory, at most ``last`` levels up, named after a method."""
    found, levels, _head = _last_named(path, METHOD_TOKEN)
    return (F.when(~path.contains(METHOD_TOKEN), F.lit(None).cast("string"))
            .when(is_plain(path) & (levels > 0), F.when(levels <= last, found))
            .otherwise(nearest_dir(path, rf"[^/]*{METHOD_TOKEN}[^/]*", METHOD_TOKEN, 1, last)))


def dataset_dir(path: Column, last: int) -> Column:
    """The nearest directory, at most ``last`` levels up, whose name has both of the dataset's tokens."""
    a, b = DATASET_TOKENS
    found, levels, _head = _last_named(path, a)
    both = is_plain(path) & (levels > 0) & F.substring_index(found, "/", -1).contains(b)
    return (F.when(~path.contains(a), F.lit(None).cast("string"))
            .when(both, F.when(levels <= last, found))
            .otherwise(nearest_dir(path, rf"[^/]*(?:{a}[^/]*{b}|{b}[^/]*{a})[^/]*", a, 1, last)))


def basename(path: Column) -> Column:
    """``os.path.basename`` of a directory path ('' for ``/``)."""
    return F.try_element_at(parts(path), F.lit(-1))


def ancestor_name(split: Column, k: int) -> Column:
    """Name of ``D(k)`` from a precomputed ``parts(path)`` ('' at or above ``/``)."""
    return F.coalesce(F.get(split, F.size(split) - F.lit(k + 1)), F.lit(""))


def py_strip(c: Column) -> Column:
    """``str.strip()``: trim Unicode whitespace on both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def py_float(c: Column) -> Column:
    """``float(text)`` with Python's accepted syntax; NULL when Python raises."""
    s = py_strip(c)
    low = F.lower(s)
    special = (F.when(low.rlike("nan"), F.lit(float("nan")))
               .when(low.startswith("-"), F.lit(float("-inf")))
               .otherwise(F.lit(float("inf"))))
    return (F.when(c.isNull(), F.lit(None).cast("double"))
            .when(c.rlike(PLAIN_NUMBER_RE), c.try_cast("double"))
            .when(c.rlike(PY_FLOAT_RE), F.regexp_replace(s, "_", "").try_cast("double"))
            .when(c.rlike(PY_SPECIAL_RE), special)
            .otherwise(F.lit(None).cast("double")))


def py_int_text(c: Column) -> Column:
    """``int(text)``: optional sign, digits (underscore groups); else NULL."""
    return F.when(c.rlike(PY_INT_RE), F.regexp_replace(py_strip(c), "_", "").try_cast("bigint"))


def backend_of(run_dir_name: Column) -> Column:
    """B1: backend from a run directory name (NULL when it does not match)."""
    return F.nullif(F.regexp_extract(run_dir_name, _u(BACKEND_TIMESTAMP_RE), 1), F.lit(""))


def timestamp_of(run_dir_name: Column) -> Column:
    """B1: run timestamp (digits, kept as text) from a run directory name."""
    return F.nullif(F.regexp_extract(run_dir_name, _u(BACKEND_TIMESTAMP_RE), 2), F.lit(""))


def is_run_dir_name(name: Column) -> Column:
    return F.left(name, F.lit(len(RUN_DIR_PREFIXES[0]))).isin(*RUN_DIR_PREFIXES)  # both are as long


def run_dir_of(path: Column, root: Column) -> Column:
    """A1: the run directory of a file below ``root``: ``root`` itself when its
    name starts with out_/out-, else the child of ``root`` on the way to the
    file when that child's name does; NULL otherwise (file not in a run)."""
    r = F.rtrim(root, F.lit("/"))
    rest = F.substring(path, F.length(r) + 2, 1 << 30)
    child = F.substring_index(rest, "/", 1)
    child_is_dir = F.instr(rest, "/") > 0
    return (F.when(is_run_dir_name(F.substring_index(r, "/", -1)), r)
            .when(child_is_dir & is_run_dir_name(child), F.concat(r, F.lit("/"), child)))


def dataset_from_path(path: Column) -> tuple[Column, Column]:
    """B2 (first step): generator and name from the leftmost match in the path."""
    return (F.nullif(F.regexp_extract(path, _u(DATASET_RE), 1), F.lit("")),
            F.nullif(F.regexp_extract(path, _u(DATASET_RE), 2), F.lit("")))


def names_dataset(path: Column) -> Column:
    """Whether ``dataset_from_path`` finds one."""
    return path.rlike(_u(DATASET_RE))


def names_metric(path: Column) -> Column:
    """Whether ``metric_from_path`` finds one."""
    return path.rlike(_u(METRIC_RE))


def metric_from_path(path: Column) -> Column:
    """B5 (first step): metric from the leftmost ``metric-<word>`` in the path."""
    return F.nullif(F.regexp_extract(path, _u(METRIC_RE), 1), F.lit(""))


def normalize_method(name: Column) -> Column:
    """B4: '-' -> '_' unless the name starts with 'linkage-'."""
    return F.when(name.startswith("linkage-"), name).otherwise(F.translate(name, "-", "_"))


def method_from_dir(base: Column, parent_base: Column) -> Column:
    """B3 (directory step): (found, method, seed) from one directory name.

    Order as in the reference: ``method-X_seed-N``, then ``method-X``, then
    ``linkage-X[_seed-N]`` below a known clustering library.
    """
    seed_name = F.regexp_extract(base, _u(METHOD_SEED_RE), 1)
    seed_num = F.regexp_extract(base, _u(METHOD_SEED_RE), 2)
    has_seed = seed_num != ""
    is_method = base.startswith("method-")
    after_dash = F.substring(base, len("method-") + 1, 1 << 30)
    is_linkage = base.startswith("linkage-") & parent_base.isin(*LINKAGE_LIBRARIES)
    lk_has_seed = base.rlike(_u(LINKAGE_SEED_RE))
    lk_name = F.concat(parent_base, F.lit("_linkage-"), F.regexp_extract(base, _u(LINKAGE_SEED_RE), 1))
    lk_seed = F.regexp_extract(base, _u(LINKAGE_SEED_RE), 2)
    null_seed = F.lit(None).cast("bigint")
    candidate = base.contains("method-") | base.startswith("linkage-")
    return (F.when(~candidate, F.struct(F.lit(False).alias("found"), F.lit(None).cast("string").alias("method"),
                                        null_seed.alias("seed")))
            .when(has_seed, F.struct(F.lit(True).alias("found"), normalize_method(seed_name).alias("method"),
                                      seed_num.try_cast("bigint").alias("seed")))
            .when(is_method, F.struct(F.lit(True).alias("found"), normalize_method(after_dash).alias("method"),
                                      null_seed.alias("seed")))
            .when(is_linkage & lk_has_seed, F.struct(F.lit(True).alias("found"), lk_name.alias("method"),
                                                     lk_seed.try_cast("bigint").alias("seed")))
            .when(is_linkage, F.struct(F.lit(True).alias("found"), F.concat(parent_base, F.lit("_"), base).alias("method"),
                                       null_seed.alias("seed")))
            .otherwise(F.struct(F.lit(False).alias("found"), F.lit(None).cast("string").alias("method"),
                                null_seed.alias("seed"))))


def method_anchor(path: Column, levels: int) -> Column:
    """The nearest of the ``levels`` directories above a file in whose name ``method_from_dir``
    finds a method; NULL if there is none."""
    token, linkage = path.contains(METHOD_TOKEN), path.contains("linkage-")
    found, up, head = _last_named(path, METHOD_TOKEN)
    libs = "|".join(LINKAGE_LIBRARIES)
    name = rf"(?:method-[^/]*|[^/]*method-(?:(?!/).)+?_seed-\d[^/]*|(?<=/(?:{libs})/)linkage-[^/]*)"
    pattern = _u(rf"^(.*/{name})(?:/[^/]+){{1,{levels}}}$")
    # the deepest name with the token begins with it, and no other rule may apply
    simple = token & ~linkage & is_plain(path) & (up > 0) & head.endswith("/" + METHOD_TOKEN)
    return (F.when(simple, F.when(up <= levels, found))
            .when(token | linkage, F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))))


def k_number(label: Column) -> Column:
    """Numeric order of a ``k=<int>`` label; anything else sorts last."""
    after = F.try_element_at(F.split(label, "="), F.lit(2))
    num = F.when(label.startswith("k="), py_int_text(after))
    return F.coalesce(num, F.lit(K_FALLBACK).cast("bigint"))


def strip_quotes(c: Column) -> Column:
    """``str.strip('"')``."""
    return F.btrim(c, F.lit('"'))


def coerce_seed(num: Column, text: Column) -> Column:
    """Python ``int(value)`` of a JSON seed: numbers truncate toward zero,
    strings must be integer literals; anything else is NULL (error)."""
    return F.coalesce(F.when(~F.isnan(num) & (F.abs(num) < 9.2e18), num.cast("bigint")),
                      F.when(num.isNull(), py_int_text(text)))
