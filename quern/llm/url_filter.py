"""URL filter: explicit rules first, then a tree of path templates for each host.

Digits in a path's segments are generalised at once. From the root on, a node of the tree that has more than
``FANOUT`` children turns the rare ones (below ``RARE`` of its rows) into a wildcard, at any depth. Sibling templates merge
into three branches: those whose share of bad labels lies more than ``Z`` standard errors above that of all their other
siblings, those as far below it, and all the rest. Each is compared with the others as a whole, so no chain of small steps
joins unlike ones. A branch is rejected when its smoothed share of bad labels, (bad + STRENGTH * prior) / (labelled +
STRENGTH), reaches ``REJECT``; the prior is the share among all labelled pages.

Labels are (page_id, bad) of the caller. The query takes them from the pages' texts alone (``page_labels``), which the url
does not give away: a page is bad if it has more than one run of marks for ``MARKED`` words, or more than one link for
``LINKED`` words. Pages that ``held_out`` names teach nothing, so that what templates say of them can be measured
(``agreement``).

Rows are counted by (host, shape) before anything else, so a host with a third of all pages is a few rows. The tree grows
by one table for each level at which some node with more than ``FANOUT`` shapes parts; what all shapes of a node have in
common is one step, however long, and nodes with fewer shapes are done. Pages meet rejected shapes by a broadcast where
these are below ``BROADCAST_BYTES``, else by a join that is salted, as a host and shape may have a third of all pages.

Cases: a null url, or one without "://", has an empty host and path and fits no rule; a page without label counts as
unlabelled; repeated label rows of a page count as one (bad if any is); repeated pages give repeated results; with no
labels at all nothing is rejected; a null page text, or one without words, is no label; a segment that is itself ``*`` is
taken for a wildcard; very long paths are whole, whatever their number of segments.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path): the rule fits the host and its subdomains where the path starts with the rule's; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FANOUT, RARE, Z, STRENGTH, REJECT = 20, 0.02, 1.96, 4.0, 0.5
#: Words for each run of marks, and for each link, that a page must have at least.
MARKED, LINKED = 10, 2
MARKS, LINK, WORD, TAG = "[#$%*|~^]+", r"<[aA][\x20\x09-\x0D>]", r"[^\x20\x09-\x0D]+", "<[^<>]*>"
#: What a reader does not see; to the end of the text where it is not closed.
UNSEEN = r"(?s)<(?:[sS][cC][rR][iI][pP][tT].*?(?:</[sS][cC][rR][iI][pP][tT]>|\z)|[sS][tT][yY][lL][eE].*?(?:</[sS][tT][yY][lL][eE]>|\z)|!--.*?(?:-->|\z))"
BROADCAST_BYTES, SALTS = 32 << 20, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered))


def shape_of(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def beside(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``found``, a written table with unique keys: broadcast below a checked size, else salted."""
    size = found.agg(F.sum(sum((F.length(F.col(c).cast("string")) for c in keys), F.lit(64)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), keys, how)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def templates(counts: DataFrame) -> DataFrame:
    """(host, shape, parent, template) of rows (host, shape, n)."""
    node = ["host", "template", "depth"]
    live = counts.select("host", "shape", "n", F.lit("").alias("template"), F.lit(0).alias("depth"), F.split("shape", "/", -1).alias("rest"))
    down = lambda steps, k: F.when(k > 0, F.concat("template", F.when(F.col("depth") > 0, "/").otherwise(""), F.concat_ws("/", steps))).otherwise(F.col("template"))
    done = []
    while True:
        # nodes that may yet have a wildcard, and how many segments all of their shapes share
        lo, hi = F.min("rest"), F.max("rest")
        parted = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False)
        many = live.where(F.size("rest") > 0).groupBy(*node).agg(F.count("*").alias("shapes"), F.when(parted > 0, parted.cast("int") - 1).otherwise(F.size(lo)).alias("common")).where(F.col("shapes") > FANOUT)
        many = written(many, "nodes")
        if many.isEmpty():
            done.append(live)
            break
        found = beside(live, many, node)
        done.append(found.where("common is null or size(rest) = 0").select(live.columns))
        found = found.where("common is not null and size(rest) > 0")
        ahead = found.select("host", "shape", "n", down(F.slice("rest", F.lit(1), F.col("common")), F.col("common")).alias("template"), (F.col("depth") + F.col("common")).alias("depth"), F.slice("rest", F.col("common") + 1, F.size("rest")).alias("rest"))
        ahead = written(ahead, "templates")
        done.append(ahead.where(F.size("rest") == 0))
        ahead = ahead.where(F.size("rest") > 0).withColumn("part", F.get("rest", F.lit(0)))
        own = ahead.groupBy(*node, "part").agg(F.sum("n").alias("own"))
        whole = own.groupBy(*node).agg(F.sum("own").alias("whole"), F.count("*").alias("fan")).where(F.col("fan") > FANOUT)
        rare = own.join(whole, node).where(F.col("own") < RARE * F.col("whole")).select(*node, "part", F.lit(True).alias("rare"))
        step = beside(ahead, written(rare, "rare"), [*node, "part"])
        part = F.array(F.when(F.col("rare"), F.lit("*")).otherwise(F.col("part")))
        live = written(step.select("host", "shape", "n", down(part, F.lit(1)).alias("template"), (F.col("depth") + 1).alias("depth"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "templates")
    rows = functools.reduce(DataFrame.unionByName, done)
    full = rows.select("host", "shape", down(F.col("rest"), F.size("rest")).alias("template"), (F.col("depth") + F.size("rest")).alias("depth"))
    parent = F.when(F.col("depth") > 1, F.regexp_replace("template", r"/[^/]*\z", "")).otherwise("")
    return full.select("host", "shape", parent.alias("parent"), "template")


def learned(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, shape, template, purity, rejected) from pages (page_id, host, shape) and labels (page_id, bad)."""
    known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")).where("bad is not null")
    counts = pages.join(known, "page_id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = written(counts, "shapes")
    total = counts.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (total[1] or 0) / total[0] if total[0] else 0.0
    tree = written(counts.join(templates(counts), ["host", "shape"]), "tree")
    own = tree.groupBy("host", "parent", "template").agg(F.sum("labelled").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    pool = own.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    own = written(own, "siblings")
    sides = beside(own, written(pool, "pools"), ["host", "parent"]).withColumn("m", F.col("all_n") - F.col("n")).withColumn("p", F.col("all_b") / F.greatest("all_n", F.lit(1.0)))
    some = (F.col("n") > 0) & (F.col("m") > 0)
    off = F.when(some, F.col("b") / F.greatest("n", F.lit(1.0)) - (F.col("all_b") - F.col("b")) / F.greatest("m", F.lit(1.0))).otherwise(0.0)
    far = F.when(some, Z * F.sqrt(F.col("p") * (1.0 - F.col("p")) * (1.0 / F.greatest("n", F.lit(1.0)) + 1.0 / F.greatest("m", F.lit(1.0))))).otherwise(0.0)
    sides = sides.select("host", "parent", "template", "n", "b", F.when(off > far, 1).when(-off > far, -1).otherwise(0).alias("branch"))
    whole = sides.groupBy("host", "parent", "branch").agg(F.sum("n").alias("branch_n"), F.sum("b").alias("branch_b"))
    purity = (F.col("branch_b") + STRENGTH * prior) / (F.col("branch_n") + STRENGTH)
    judged = beside(sides, written(whole, "branches"), ["host", "parent", "branch"]).select("host", "parent", "template", purity.alias("purity"))
    found = beside(tree.select("host", "shape", "parent", "template"), written(judged, "judged"), ["host", "parent", "template"])
    return written(found.select("host", "shape", "template", "purity", (F.col("purity") >= REJECT).alias("rejected")), "learned")


def page_labels(pages: DataFrame) -> DataFrame:
    """(page_id, bad) from (page_id, html), whatever the url."""
    # a step for each column that is used twice, so that none is computed twice
    seen = pages.select("page_id", F.regexp_replace("html", UNSEEN, " ").alias("seen"))
    texts = seen.select("page_id", F.regexp_count("seen", F.lit(LINK)).alias("links"), F.regexp_replace("seen", TAG, " ").alias("text"))
    counts = texts.select("page_id", "links", F.regexp_count("text", F.lit(MARKS)).alias("marks"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    bad = F.when(F.col("words") > 0, (MARKED * F.col("marks") > F.col("words")) | (LINKED * F.col("links") > F.col("words")))
    return counts.select("page_id", bad.alias("bad"))


def held_out(key: Column) -> Column:
    """A fifth of the pages, by their ids."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page's url."""
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("shape", shape_of(F.col("path")))
    # what is not rejected is allowed: only the rejected shapes meet the pages
    found = beside(base, learned(base, labels).where("rejected").select("host", "shape", "rejected"), ["host", "shape"])
    found = found.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"))


def agreement(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(verdict, bad, n) of the pages that no rule decides and that are held out."""
    return judged.where(F.col("rule").isNull() & held_out(F.col("page_id"))).join(labels, "page_id").groupBy("verdict", "bad").agg(F.count("*").alias("n"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, page_labels(pages.where(~held_out(F.col("page_id")))))


def _fits(rules: Sequence[tuple[str, str, str]], value: str) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    one = lambda r: f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{r[1] + r[2] if value == 'rule' else r[0]}'"
    return f"CASE {' '.join(map(one, ordered))} END"


# DuckDB has no crc32: whether it is divisible by five comes from its bits, folded over the bytes of the id.
_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
b AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u),
h AS (SELECT page_id, regexp_replace(html, '{UNSEEN}', ' ', 'g') AS seen FROM pages
  WHERE page_id IS NULL OR xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: {_BYTE}), 4294967295) % 5 <> 0),
x AS (SELECT page_id, seen, regexp_replace(seen, '{TAG}', ' ', 'g') AS words FROM h),
y AS (SELECT page_id, len(regexp_extract_all(words, '{WORD}')) AS n, len(regexp_extract_all(words, '{MARKS}')) AS marks, len(regexp_extract_all(seen, '{LINK}')) AS links FROM x WHERE seen IS NOT NULL),
k AS (SELECT page_id, max(CAST({MARKED} * marks > n OR {LINKED} * links > n AS INTEGER)) AS bad FROM y WHERE n > 0 GROUP BY page_id),
c AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM b LEFT JOIN k USING (page_id) GROUP BY ALL),
prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN CAST(sum(bad) AS DOUBLE) / sum(labelled) ELSE 0e0 END AS prior FROM c),
r AS (SELECT host, shape, n, string_split(shape, '/') AS parts, 0 AS depth, '' AS parent, '' AS template FROM c
  UNION ALL
  SELECT host, shape, n, parts, depth + 1, template, template || CASE WHEN depth > 0 THEN '/' ELSE '' END || CASE WHEN fan > {FANOUT} AND own < {RARE}e0 * whole THEN '*' ELSE part END
  FROM (SELECT *, parts[depth + 1] AS part, sum(n) OVER (PARTITION BY host, template, parts[depth + 1]) AS own, sum(n) OVER (PARTITION BY host, template) AS whole,
      count(DISTINCT parts[depth + 1]) OVER (PARTITION BY host, template) AS fan FROM r WHERE len(parts) > depth)),
t AS (SELECT host, shape, parent, template FROM r WHERE depth = len(parts)),
own AS (SELECT host, parent, template, CAST(sum(labelled) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b FROM c JOIN t USING (host, shape) GROUP BY ALL),
pool AS (SELECT host, parent, sum(n) AS an, sum(b) AS ab FROM own GROUP BY ALL),
s AS (SELECT host, parent, template, n, b, an, ab, an - n AS m, ab / greatest(an, 1e0) AS p FROM own JOIN pool USING (host, parent)),
e AS (SELECT *, CASE WHEN n > 0 AND m > 0 THEN b / greatest(n, 1e0) - (ab - b) / greatest(m, 1e0) ELSE 0e0 END AS off,
  CASE WHEN n > 0 AND m > 0 THEN {Z}e0 * sqrt(p * (1e0 - p) * (1e0 / greatest(n, 1e0) + 1e0 / greatest(m, 1e0))) ELSE 0e0 END AS far FROM s),
g AS (SELECT host, parent, template, n, b, CASE WHEN off > far THEN 1 WHEN -off > far THEN -1 ELSE 0 END AS branch FROM e),
w AS (SELECT host, parent, branch, sum(n) AS wn, sum(b) AS wb FROM g GROUP BY ALL),
j AS (SELECT host, parent, template, (wb + {STRENGTH}e0 * prior) / (wn + {STRENGTH}e0) AS purity FROM g JOIN w USING (host, parent, branch), prior),
v AS (SELECT host, shape, CASE WHEN purity >= {REJECT}e0 THEN 'block' ELSE 'allow' END AS own FROM t JOIN j USING (host, parent, template))
SELECT page_id, host, path, {_fits(RULES, "rule")} AS rule, coalesce({_fits(RULES, "verdict")}, own, 'allow') AS verdict FROM b LEFT JOIN v USING (host, shape)
"""


def brute_force(pages: list[tuple], labels: list[tuple], rules=RULES) -> list[tuple]:
    """The same verdicts by a plain tree, for tests."""
    import re
    from collections import defaultdict

    bad: dict = {}
    for i, b in labels:
        if b is not None:
            bad[i] = max(bad.get(i, False), b)
    parsed = []
    for i, url in pages:
        m = re.match(URL, url or "")
        host = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in m[1]) if m else ""
        parsed.append((i, host, m[2] if m else "", [re.sub("[0-9]+", "#", x) for x in (m[2] if m else "").split("/")]))
    at = {k: ("", "") for k in range(len(parsed))}
    for d in range(max((len(x[3]) for x in parsed), default=0)):
        kids: dict = defaultdict(lambda: defaultdict(list))
        for k, (_, host, _, parts) in enumerate(parsed):
            if len(parts) > d:
                kids[host, at[k][1]][parts[d]].append(k)
        for (_, tpl), by in kids.items():
            whole = sum(map(len, by.values()))
            for part, members in by.items():
                step = "*" if len(by) > FANOUT and len(members) < RARE * whole else part
                for k in members:
                    at[k] = (tpl, tpl + ("/" if d else "") + step)
    own, pool, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for k, (i, host, _, _) in enumerate(parsed):
        for x in (own[host, *at[k]], pool[host, at[k][0]], total):
            x[0] += bad.get(i) is not None
            x[1] += bool(bad.get(i))
    prior = total[1] / total[0] if total[0] else 0.0
    branches: dict = defaultdict(list)
    for (host, parent, tpl), (n, b) in own.items():
        all_n, all_b = pool[host, parent]
        off = far = 0.0
        if n and all_n > n:
            p = all_b / all_n
            off, far = b / n - (all_b - b) / (all_n - n), Z * (p * (1 - p) * (1 / n + 1 / (all_n - n))) ** 0.5
        branches[host, parent, (off > far) - (-off > far)].append((tpl, n, b))
    purity = {}
    for (host, parent, _), row in branches.items():
        n, b = (sum(x[k] for x in row) for k in (1, 2))
        purity.update({(host, parent, x[0]): (b + STRENGTH * prior) / (n + STRENGTH) for x in row})
    out = []
    for k, (i, host, path, _) in enumerate(parsed):
        fit = max((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
        own_verdict = "block" if purity[host, *at[k]] >= REJECT else "allow"
        out.append((i, host, path, fit and fit[1] + fit[2], fit[0] if fit else own_verdict))
    return out
