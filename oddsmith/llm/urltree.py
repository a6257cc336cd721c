"""URL filters: rules of host and path first, then a tree of path templates a host. Built-in functions only.

Paths are read as segments, in which runs of digits and long hexadecimal numbers count as one. A host's tree grows level by
level over counts of equal paths, never over rows:

1. at a node, a segment that few of the node's urls have is variable; the variable ones become one wildcard branch.
2. branches whose urls are alike are merged: alike are shares that differ by no more than Hoeffding's bound allows for two
   samples of their sizes, as in the inference of automata from samples. Compared are the shares that end there, that rules
   block and that rules allow. A branch is held against the node's pools of branches with more blocked, with more allowed
   and with as many of both, not against every sibling: it joins the largest pool if it is like it, else its own pool if it is
   like that, else it stays by itself.
3. a leaf is a template. It is rejected if the smoothed share of blocked urls among its labelled ones is high enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

Rule = tuple[str, str, str]
DEPTH = 6
END, REST = "", "**"  # the marks of a path's end and of what lies below the tree's depth
POOLS = ("block", "allow", "none")
NUMBER = "[0-9a-f]{16,}|[0-9]+"


def url_host(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A-Z lower-cased; "" where there is none."""
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format("_url"))
    own = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; "" where there is no host."""
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format("_url"))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path together; ties: the longer host) that fits, as a struct of verdict and rule; null if none.

    Rules are a list that every task holds, looked through once a url: some thousands at most.
    """
    if not rules:
        return F.lit(None).cast("struct<verdict: string, rule: string>")
    known = [F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in dict.fromkeys(rules)]
    fits = F.filter(F.array(*known), lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), F.concat(best["host"], best["path"]).alias("rule")))


def path_segments(path: Column, depth: int) -> Column:
    """Segments with numbers taken as one, the path's end marked; from the tree's depth on, one mark for all."""
    parts = F.transform(F.split(F.substring(path, 2, 1 << 30), "/", -1), lambda s: F.regexp_replace(s, NUMBER, "#"))
    whole = F.when(F.length(path) == 0, F.array(F.lit(END))).otherwise(F.concat(F.transform(parts, lambda s: F.concat(F.lit("/"), s)), F.array(F.lit(END))))
    return F.when(F.size(whole) > depth, F.concat(F.slice(whole, 1, depth - 1), F.array(F.lit(REST)))).otherwise(whole)


def _apart(x: Column, n: Column, y: Column, m: Column, width: float) -> Column:
    """Whether x of n and y of m are shares that differ by more than the bound."""
    n, m = n.cast("double"), F.nullif(m.cast("double"), F.lit(0.0))
    return F.abs(x / n - y / m) > F.lit(width) * (1 / F.sqrt(n) + 1 / F.sqrt(m))


def _unlike(pool: str, width: float) -> Column:
    """Whether a branch differs from the pool; in its own pool it counts on both sides."""
    out = F.lit(False)
    for c in ("ends", "block", "allow"):
        out = out | _apart(F.col(c), F.col("n"), F.col(f"{pool}_{c}"), F.col(f"{pool}_n"), width)
    return out


def templates(shapes: DataFrame, depth: int, least_share: float, least_urls: int, doubt: float) -> DataFrame:
    """(host, segments, n, block, allow) -> the same rows with their template, an array of branches.

    least_share, least_urls: a segment is a literal if it has that share of its node's urls and as many, else variable.
    doubt: the chance at which Hoeffding's bound takes two samples of one kind for different.
    """
    width = math.sqrt(0.5 * math.log(2 / doubt))
    state = shapes.withColumn("template", F.array().cast("array<string>"))
    deepest = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, min(depth, deepest) + 1):
        old = state
        open_ = state.where(F.size("segments") >= level).withColumn("t", F.element_at("segments", level))
        sums = [F.sum(c).alias(c) for c in ("n", "ends", "block", "allow")]
        ends = F.when(F.col("t").isin(END, REST) | (F.get("segments", F.lit(level)) == END), F.col("n")).otherwise(0)
        segments = open_.withColumn("ends", ends).groupBy("host", "template", "t").agg(*sums)
        nodes = segments.groupBy("host", "template").agg(F.sum("n").alias("node_n"))
        literal = F.col("t").isin(END, REST) | ((F.col("n") >= least_urls) & (F.col("n") >= F.lit(least_share) * F.col("node_n")))
        named = segments.join(nodes, ["host", "template"]).withColumn("branch", F.when(literal, F.col("t")).otherwise(F.lit("/*")))
        named = materialize(named.select("host", "template", "t", "branch", "n", "ends", "block", "allow"), "named")
        branches = named.groupBy("host", "template", "branch").agg(*sums)
        most = F.when(F.col("block") > F.col("allow"), "block").when(F.col("allow") > F.col("block"), "allow").otherwise("none")
        branches = branches.withColumn("pool", most)
        inner = ~F.col("branch").isin(END, REST)
        pools = branches.where(inner).groupBy("host", "template").agg(
            *[F.sum(F.when(F.col("pool") == p, F.col(c)).otherwise(0)).alias(f"{p}_{c}") for p in POOLS for c in ("n", "ends", "block", "allow")],
            *[F.min(F.when(F.col("pool") == p, F.col("branch"))).alias(f"{p}_first") for p in POOLS],
        )
        largest = F.greatest(*[F.col(f"{p}_n") for p in POOLS])
        judged = branches.where(inner).join(pools, ["host", "template"])
        joins = F.lit(None).cast("string")
        for p in reversed(POOLS):
            joins = F.when((F.col("pool") == p) & ~_unlike(p, width), F.lit(p)).otherwise(joins)
        for p in reversed(POOLS):  # of equal pools the first
            joins = F.when((F.col(f"{p}_n") == largest) & ~_unlike(p, width), F.lit(p)).otherwise(joins)
        first = F.lit(None).cast("string")
        for p in POOLS:
            first = F.when(F.col("joins") == p, F.col(f"{p}_first")).otherwise(first)
        merged = judged.withColumn("joins", joins).select("host", "template", "branch", F.coalesce(F.concat(first, F.lit("+")), F.col("branch")).alias("merged"))
        step = named.select("host", "template", "t", "branch").join(merged, ["host", "template", "branch"], "left")
        step = step.select("host", "template", "t", F.coalesce("merged", "branch").alias("step"))
        grown = open_.join(step, ["host", "template", "t"]).select("host", "segments", "n", "block", "allow", F.concat("template", F.array("step")).alias("template"))
        state = materialize(grown.union(state.where(F.size("segments") < level)), "tree")
        for table in (named, old):
            discard(table)
    return state


def url_verdicts(pages: DataFrame, rules: list[Rule], label: str | None = None, depth: int = DEPTH, least_share: float = 0.05, least_urls: int = 2,
                 doubt: float = 0.05, reject: float = 0.8, smooth: float = 4.0) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template, purity.

    The longest rule that fits gives the verdict. Elsewhere the page's template does: it is blocked if purity, the share
    (blocked + smooth / 2) / (labelled + smooth) of its urls, is `reject` or more, and allowed otherwise, so six blocked urls and no
    other labelled one are the least that rejects. A url is labelled by its rule or, where none fits, by the column
    `label` of pages ("block", "allow", else unlabelled).

    Null url, or one without "://": host and path are empty and such rows form a host of their own. Repeated rows: each counts.
    Null page_ids and other columns, whatever their names, do no harm; the latter go. No rows: no rows. Long paths are matched
    whole; in the tree what lies below `depth` segments is one wildcard. A host may hold any share of the rows: they are
    summed by equal paths before anything else, and verdicts meet rows by host and path.
    """
    own = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("_label"))
    own = own.select("page_id", "_label", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    own = own.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", path_segments(F.col("path"), depth))
    known = F.coalesce(F.col("_rule.verdict"), F.col("_label"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    shapes = own.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), count(known == "block")("block"), count(known == "allow")("allow"))
    grown = templates(materialize(shapes, "shapes"), depth, least_share, least_urls, doubt)
    sums = grown.groupBy("host", "template").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    purity = (F.col("block") + smooth / 2) / (F.col("block") + F.col("allow") + smooth)
    leaves = grown.select("host", "segments", "template").join(sums.select("host", "template", purity.alias("purity")), ["host", "template"])
    leaves = materialize(leaves.select("host", "segments", F.array_join("template", "").alias("template"), "purity"), "leaves")
    judged = own.join(leaves, ["host", "segments"])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def oracle(rules: list[Rule], depth: int = DEPTH, least_share: float = 0.05, least_urls: int = 2, doubt: float = 0.05, reject: float = 0.8, smooth: float = 4.0) -> str:
    """The same over a table pages, a level of the tree by a few common table expressions."""
    width = repr(math.sqrt(0.5 * math.log(2 / doubt)))
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "substr(url, instr(url, '://') + 3)"
    out = [f"""
rules(verdict, host, path) as (values {values}),
parsed as (
  select row_number() over () as i, page_id, case when contains(url, '://') then {lower.format(f"regexp_extract({rest}, '^[^/?#]*')")} else '' end as host,
         case when contains(url, '://') then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path
  from (select page_id, coalesce(url, '') as url from pages)),
fitting as (
  select i, r.host || r.path as rule, verdict, row_number() over (partition by i order by len(r.host) + len(r.path) desc, len(r.host) desc, verdict desc) as k
  from parsed p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)),
cut as (
  select p.*, f.rule, f.verdict,
         case when p.path = '' then [''] else list_append([ '/' || regexp_replace(s, '{NUMBER}', '#', 'g') for s in string_split(substr(p.path, 2), '/')], '') end as whole
  from parsed p left join fitting f on f.i = p.i and f.k = 1),
own as (select *, case when len(whole) > {depth} then list_append(whole[1:{depth - 1}], '{REST}') else whole end as segments from cut),
state0 as (
  select host, segments, count(*)::bigint as n, count(*) filter (verdict = 'block')::bigint as block, count(*) filter (verdict = 'allow')::bigint as allow, [] ::varchar[] as template
  from own group by host, segments)"""]
    for k in range(1, depth + 1):
        unlike = {p: " or ".join(f"abs({c} / n - {p}_{c} / {p}_n) > {width} * (1 / sqrt(n) + 1 / sqrt({p}_n))" for c in ("ends", "block", "allow")) for p in POOLS}
        largest = "greatest(" + ", ".join(f"{p}_n" for p in POOLS) + ")"
        cases = " ".join(f"when {p}_n = {largest} and not ({unlike[p]}) then '{p}'" for p in POOLS) + " " + " ".join(f"when pool = '{p}' and not ({unlike[p]}) then '{p}'" for p in POOLS)
        pools = ", ".join(f"coalesce(sum({c}) filter (pool = '{p}'), 0)::double as {p}_{c}" for p in POOLS for c in ("n", "ends", "block", "allow"))
        firsts = ", ".join(f"min(branch) filter (pool = '{p}') as {p}_first" for p in POOLS)
        out.append(f"""
open{k} as (
  select *, segments[{k}] as t,
         case when segments[{k}] in ('{END}', '{REST}') or coalesce(segments[{k + 1}] = '{END}', false) then n else 0 end as ends
  from state{k - 1} where len(segments) >= {k}),
segments{k} as (select host, template, t, sum(n) as n, sum(ends) as ends, sum(block) as block, sum(allow) as allow from open{k} group by all),
named{k} as (
  select *, case when t in ('{END}', '{REST}') or (n >= {least_urls} and n >= {least_share} * sum(n) over (partition by host, template)) then t else '/*' end as branch
  from segments{k}),
branches{k} as (
  select *, case when block > allow then 'block' when allow > block then 'allow' else 'none' end as pool
  from (select host, template, branch, sum(n) as n, sum(ends) as ends, sum(block) as block, sum(allow) as allow from named{k} group by all)),
pools{k} as (select host, template, {pools}, {firsts} from branches{k} where branch not in ('{END}', '{REST}') group by host, template),
merged{k} as (
  select host, template, branch, case joins {" ".join(f"when '{p}' then {p}_first || '+'" for p in POOLS)} else branch end as step
  from (select *, case {cases} end as joins from branches{k} join pools{k} using (host, template) where branch not in ('{END}', '{REST}'))),
state{k} as (
  select o.host, o.segments, o.n, o.block, o.allow, list_append(o.template, coalesce(m.step, d.branch)) as template
  from open{k} o join named{k} d using (host, template, t) left join merged{k} m on m.host = d.host and m.template = d.template and m.branch = d.branch
  union all select * from state{k - 1} where len(segments) < {k})""")
    out.append(f"""
leaves as (
  select host, segments, array_to_string(template, '') as template,
         (sum(block) over w + {smooth / 2}::double) / (sum(block) over w + sum(allow) over w + {smooth}::double) as purity
  from state{depth} window w as (partition by host, template))""")
    return "with " + ",".join(out) + f"""
select page_id, host, path, rule, coalesce(verdict, case when purity >= {reject}::double then 'block' else 'allow' end) as verdict, template, purity
from own join leaves using (host, segments)
"""
