"""URL filter: explicit rules, then a path-template tree judged by the rules' own verdicts.

Pages that a rule judges are the labelled ones. Per host, paths form a tree:

1. Segments are typed: runs of digits and long hexadecimal runs become `{num}` and `{hex}`.
   Pages collapse to distinct shapes per host with counts of pages, labelled and blocked ones.
2. Branching point by branching point, to the deepest path there is, a segment stays literal when it
   has pages enough and its share of blocked pages differs significantly (two proportions, 5 %) from its
   siblings' share; every other segment becomes `*`. So variable segments turn into wildcards and
   statistically similar branches merge. What all shapes of a branch share is stepped over
   at once, and a branch ends where nothing can be told apart any more: a single shape, no label, too few pages.
3. A template is rejected when its smoothed share of blocked pages, (blocked + PRIOR * WEIGHT) /
   (labelled + WEIGHT), reaches `REJECT`. Templates without evidence are allowed.

DataFrame functions only. A hot host costs nothing extra: pages are combined per
shape before the first shuffle, and all that follows works on shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import stored

Rule = tuple[str, str, str]  # verdict, host, path
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_PAGES = 5  # of a literal segment
CHI_SQUARE = 3.841458820694124  # 95 % point at one degree of freedom
WEIGHT, PRIOR, REJECT = 10.0, 0.25, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"
REST = "{rest}"
TREE = ("host", "shape", "n", "labelled", "blocked", "template")


def host_and_path(pages: DataFrame) -> DataFrame:
    """Host and path of each url; both empty for null or without `://`."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substr(F.col("url"), at + F.lit(3))).otherwise("")
    out = pages.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    out = out.withColumn("raw_host", host)
    path = F.regexp_extract(F.substr(F.col("rest"), F.length("raw_host") + F.lit(1)), "^[^?#]*", 0)
    return out.withColumn("path", path).withColumn("host", F.translate("raw_host", UPPER, LOWER)).drop("rest", "raw_host")


def _fits(rule: Rule) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def _first(rules: tuple[Rule, ...], value) -> Column:
    """The longest fitting rule's value, else null; of equally long rules the first in order."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        out = F.when(_fits(rule), F.lit(value(rule))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, template, labelled, blocked.

    rule: the fitting rule as host and path, else null. verdict: the rule's, else the
    template's. template: host and generalised path; labelled, blocked: its evidence.

    Defined cases: a null url, or one without `://`, has an empty host and path and
    is allowed unless a rule fits the empty host; an empty path has no segment; repeated
    rows are judged each and count each; an empty table gives no rows; other
    columns are not read.
    """
    judged = host_and_path(pages.select("page_id", "url"))
    judged = judged.withColumn("rule", _first(rules, lambda r: r[1] + r[2])).withColumn("ruled", _first(rules, lambda r: r[0]))
    typed = F.regexp_replace(F.regexp_replace("path", "[0-9a-f]{16,}", "{hex}"), "[0-9]+", "{num}")
    shaped = judged.drop("url").withColumn("shape", typed)

    shapes = shaped.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"),
        F.coalesce(F.sum((F.col("ruled") == "block").cast("long")), F.lit(0)).alias("blocked"))
    parts = F.split("shape", "/")
    # the first part lies before the first slash and is empty
    rest = F.concat(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit(END)))
    open_ = stored(shapes.select("*", F.col("host").alias("template"), rest.alias("rest")), "url-shapes")
    ended = None
    while True:
        step = stored(_shared_part(open_), "url-branches")
        over = step.where("ended").select(*TREE)
        ended = over if ended is None else ended.unionByName(over)
        going = step.where(~F.col("ended"))
        if going.isEmpty():
            break
        open_ = stored(_branch(going), "url-tree")
    found = ended.groupBy("host", "template").agg(F.sum("labelled").alias("labelled_"), F.sum("blocked").alias("blocked_"))
    verdicts = stored(ended.join(found, ["host", "template"]).select(
        "host", "shape", "template", F.col("labelled_").alias("labelled"), F.col("blocked_").alias("blocked")), "url-templates")
    rejected = (F.col("blocked") + PRIOR * WEIGHT) / (F.col("labelled") + WEIGHT) >= REJECT
    verdict = F.coalesce("ruled", F.when(rejected, "block").otherwise("allow"))
    return shaped.join(verdicts, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "labelled", "blocked")


def _shared_part(tree: DataFrame) -> DataFrame:
    """Step over the segments that all shapes of a branch share, and mark the branches that end.

    The least and the greatest of a branch's remaining paths share just what all of them share.
    """
    branch = tree.groupBy("host", "template").agg(
        F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"))
    same = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    branch = branch.select(
        "host", "template", F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int").alias("common"),
        (F.col("low") == F.col("high")).alias("one"),
        ((F.col("low") == F.col("high")) | (F.col("all_labelled") == 0) | (F.col("all_n") < MIN_PAGES)).alias("ended"))
    passed = F.slice("rest", F.lit(1), F.col("common"))
    left = F.slice("rest", F.col("common") + 1, F.greatest(F.size("rest") - F.col("common"), F.lit(0)))
    onward = F.concat_ws("/", "template", passed)
    template = F.when(F.col("ended") & ~F.col("one"), F.concat_ws("/", onward, F.lit(REST))).otherwise(onward)
    return tree.join(branch, ["host", "template"]).select(
        "host", "shape", "n", "labelled", "blocked", template.alias("template"), left.alias("rest"), "ended")


def _branch(tree: DataFrame) -> DataFrame:
    """One segment further: literal where it stands out among its siblings, else `*`."""
    next_ = tree.withColumn("segment", F.coalesce(F.get("rest", F.lit(0)), F.lit(END)))
    child = next_.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    parent = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")])
    kept = child.join(parent, ["host", "template"]).where(_stands_out()).select("host", "template", "segment", F.lit(True).alias("literal"))
    segment = F.when(F.col("literal"), F.col("segment")).otherwise("*")
    return next_.join(kept, ["host", "template", "segment"], "left").select(
        "host", "shape", "n", "labelled", "blocked", F.concat_ws("/", "template", segment).alias("template"),
        F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"))


def _stands_out() -> Column:
    """Of pages enough, labelled, and blocked at another rate than its siblings (or alone in being labelled)."""
    n1, b1 = F.col("labelled").cast("double"), F.col("blocked").cast("double")
    n, b = F.col("all_labelled").cast("double"), F.col("all_blocked").cast("double")
    n2, b2 = n - n1, b - b1
    gap = b1 * n2 - b2 * n1
    differs = gap * gap * n > F.lit(CHI_SQUARE) * (b * (n - b)) * (n1 * n2)
    return (F.col("n") >= MIN_PAGES) & (n1 > 0) & ((n2 == 0) | differs)


def _sql(rules: tuple[Rule, ...]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def case(value) -> str:
        fits = lambda r: f"(host = {quoted(r[1])} OR ends_with(host, {quoted('.' + r[1])})) AND starts_with(path, {quoted(r[2])})"
        return "CASE " + " ".join(f"WHEN {fits(r)} THEN {quoted(value(r))}" for r in ordered) + " END"

    return f"""WITH RECURSIVE
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM cut),
parsed AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts),
shaped AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled,
  regexp_replace(regexp_replace(path, '[0-9a-f]{{16,}}', '{{hex}}', 'g'), '[0-9]+', '{{num}}', 'g') AS shape FROM parsed),
shapes AS (SELECT host, shape, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM shaped GROUP BY host, shape),
tree AS (
  SELECT host, shape, n, labelled, blocked, host AS template, list_append(string_split(shape, '/')[2:], '{END}') AS rest, false AS ended FROM shapes
  UNION ALL
  SELECT host, shape, n, labelled, blocked,
    CASE WHEN low = high THEN onward WHEN over THEN onward || '/{REST}' ELSE onward || '/' || CASE WHEN
      cn >= {MIN_PAGES} AND n1 > 0 AND (al - n1 = 0 OR
        (b1 * (al - n1) - (ab - b1) * n1) * (b1 * (al - n1) - (ab - b1) * n1) * al > CAST({CHI_SQUARE} AS DOUBLE) * (ab * (al - ab)) * (n1 * (al - n1)))
      THEN segment ELSE '*' END END,
    left_over[2:], over
  FROM (
    SELECT *, CAST(sum(n) OVER c AS DOUBLE) AS cn, CAST(sum(labelled) OVER c AS DOUBLE) AS n1, CAST(sum(blocked) OVER c AS DOUBLE) AS b1
    FROM (
      SELECT *, rest[common + 1:] AS left_over, coalesce(rest[common + 1], '{END}') AS segment,
        template || CASE WHEN common > 0 THEN '/' || array_to_string(rest[1:common], '/') ELSE '' END AS onward,
        low = high OR al = 0 OR an < {MIN_PAGES} AS over
      FROM (
        SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(low), len(high)) + 1), lambda i: low[i] IS NOT DISTINCT FROM high[i]), false) - 1,
                           len(low)) AS common
        FROM (SELECT host, shape, n, labelled, blocked, template, rest, min(rest) OVER b AS low, max(rest) OVER b AS high, CAST(sum(n) OVER b AS DOUBLE) AS an,
                CAST(sum(labelled) OVER b AS DOUBLE) AS al, CAST(sum(blocked) OVER b AS DOUBLE) AS ab
              FROM tree WHERE NOT ended WINDOW b AS (PARTITION BY host, template))))
    WINDOW c AS (PARTITION BY host, template, segment))),
ended AS (SELECT host, shape, template, labelled, blocked FROM tree WHERE ended),
found AS (SELECT host, template, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(blocked) AS BIGINT) AS blocked FROM ended GROUP BY host, template),
verdicts AS (SELECT ended.host, shape, template, found.labelled, found.blocked FROM ended JOIN found USING (host, template))
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN (blocked + {PRIOR * WEIGHT}) / (labelled + {WEIGHT}) >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  template, labelled, blocked
FROM shaped JOIN verdicts USING (host, shape)"""


SQL = _sql(RULES)
