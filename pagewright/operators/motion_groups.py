"""Groups of motion papers: packets as groups, every rule they must keep, and whether saved groups still hold for today's inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.stages import written_once

#: Bases of a date, roles in a group, the note that every group bears, and what is said where saved groups aren't used.
BASES = ("filed", "document", "unknown")
LEAD, CONTINUATION, ALONE = "lead", "continuation", "unresolved"
NOTE = "Grouped by uninterrupted motion classification, not a finding that all papers support the same request. Distinct or opposing positions remain distinct."
NO_GROUPS = "Grouping unavailable; using named physical entries. Run Organize motion papers to adopt packets."
STALE_GROUPS = "Grouping is stale; using named physical entries. Rerun Organize motion papers."
LABEL_CHARACTERS = 1024

INVENTORY = ["paper_id", "start_page", "end_page", "title", "date", "date_basis"]


def paper_id(start: Column) -> Column:
    return F.format_string("motion:%04d", start)


def bad_label(x: Column) -> Column:
    """Missing, too long, or with characters that don't print (controls, formats, separators other than the space)."""
    return F.coalesce((F.length(x) > LABEL_CHARACTERS) | x.rlike(r"[\p{C}\p{Z}&&[^ ]]"), F.lit(True))


def not_sure(x: Column) -> Column:
    """True where a condition fails or can't be judged."""
    return ~F.coalesce(x, F.lit(False))


def canonical(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of papers (case_id, packet_page, and INVENTORY): the papers of one packet_page are a group, led by the first.

    members: case_id, group_id, place (from 0), paper_id, role, start_page, end_page.
    """
    w = Window.partitionBy("case_id", "packet_page").orderBy("start_page", "paper_id")
    rows = papers.withColumn("place", F.row_number().over(w) - 1).withColumn("group_id", F.first("paper_id").over(w))
    role = F.when(F.col("place") == 0, LEAD).otherwise(CONTINUATION)
    members = rows.select("case_id", "group_id", "place", "paper_id", role.alias("role"), "start_page", "end_page")
    groups = rows.where("place = 0").select("case_id", "group_id", F.col("start_page").alias("anchor_page"), "title", "date", "date_basis", F.lit(NOTE).alias("note"))
    return groups, members


def inventory_issues(inventory: DataFrame) -> DataFrame:
    """(case_id, subject, rule) of the papers of an inventory; subject is the paper's id."""
    w = Window.partitionBy("case_id").orderBy("start_page", "end_page", "paper_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = inventory.withColumn("before", F.coalesce(F.max("end_page").over(w), F.lit(0)))
    rows = rows.withColumn("times", F.count("*").over(Window.partitionBy("case_id", "paper_id")))
    rules = F.array(
        F.when(not_sure((F.col("start_page") >= 1) & (F.col("start_page") <= F.col("end_page")) & (F.col("start_page") > F.col("before"))), F.lit("invalid_range")),
        F.when(not_sure((F.col("paper_id") == paper_id(F.col("start_page"))) & (F.col("times") == 1)), F.lit("duplicate_id")),
        F.when(bad_label(F.col("title")) | bad_label(F.col("date")) | (F.trim("title") != F.col("title")), F.lit("invalid_label")),
        F.when(not_sure(F.col("date_basis").isin(*BASES)), F.lit("invalid_fields")),
    )
    return rows.select("case_id", F.col("paper_id").alias("subject"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def group_issues(inventory: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(case_id, subject, rule), one row for each rule that a paper, member or group breaks. An empty result proves a partition.

    inventory: case_id and INVENTORY; groups and members as of canonical. A paper is in exactly one group (paper: incomplete_membership,
    invalid_membership), a member is a paper of the inventory with its pages (invalid_reference, invalid_range), members follow each other
    page by page in the order of their places (invalid_continuity), the first leads and has a title (invalid_lead, invalid_role); a group
    has its lead's id, page, title and date and the note (invalid_reference, invalid_range, invalid_lead_metadata, invalid_explanation),
    isn't there twice, and doesn't begin right after the end of another (split_continuity). A member without a group is unknown_group.

    Nulls break the rule that asks for them. Groups and members meet the inventory by (case_id, paper_id), so a case of any size is
    spread over tasks except for the two windows in page order over papers and groups, whose rows are numbers and short texts. The three sides
    are written once when this is called, as each is met several times.
    """
    inventory, groups, members = map(written_once, (inventory, groups, members))
    ids = inventory.groupBy("case_id", "paper_id").agg(F.min_by(F.struct("start_page", "end_page", "title", "date", "date_basis"), F.struct("start_page", "end_page")).alias("p"))
    named = groups.select("case_id", "group_id").distinct().withColumn("grouped", F.lit(True))
    held = members.groupBy("case_id", "paper_id").agg(F.count("*").alias("n"))
    papers = ids.join(held, ["case_id", "paper_id"], "left").select("case_id", F.col("paper_id").alias("subject"), F.when(F.col("n").isNull(), "incomplete_membership").when(F.col("n") > 1, "invalid_membership").alias("rule"))

    inside = Window.partitionBy("case_id", "group_id").orderBy("place", "paper_id")
    rows = members.join(ids, ["case_id", "paper_id"], "left").join(named, ["case_id", "group_id"], "left")
    first = F.row_number().over(inside) == 1
    rows = rows.withColumn("first", first).withColumn("came", F.lag("p.end_page").over(inside))
    rules = F.array(
        F.when(F.col("p").isNull(), F.lit("invalid_reference")), F.when(F.col("grouped").isNull(), F.lit("unknown_group")),
        F.when(F.col("p").isNotNull() & not_sure((F.col("start_page") == F.col("p.start_page")) & (F.col("end_page") == F.col("p.end_page"))), F.lit("invalid_range")),
        F.when(not_sure(F.col("role") == F.when(F.col("first"), LEAD).otherwise(CONTINUATION)), F.lit("invalid_role")),
        F.when(~F.col("first") & not_sure(F.col("came") + 1 == F.col("p.start_page")), F.lit("invalid_continuity")),
        F.when(F.col("first") & not_sure((F.col("group_id") == F.col("paper_id")) & (F.col("p.title") != "")), F.lit("invalid_lead")),
    )
    of_members = rows.select("case_id", F.col("paper_id").alias("subject"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))

    lasts = members.join(ids, ["case_id", "paper_id"]).groupBy("case_id", "group_id").agg(F.max("p.end_page").alias("reach"), F.count("*").alias("held"))
    rows = groups.join(ids.withColumnRenamed("paper_id", "group_id"), ["case_id", "group_id"], "left").join(lasts, ["case_id", "group_id"], "left")
    order = Window.partitionBy("case_id").orderBy("anchor_page", "group_id")
    rows = rows.withColumn("times", F.count("*").over(Window.partitionBy("case_id", "group_id"))).withColumn("end_before", F.lag("reach").over(order))
    told = (F.col("title") == F.col("p.title")) & (F.col("date") == F.col("p.date")) & (F.col("date_basis") == F.col("p.date_basis"))
    rules = F.array(
        F.when(F.col("p").isNull() | (F.col("times") > 1), F.lit("invalid_reference")), F.when(F.col("held").isNull(), F.lit("empty_group")),
        F.when(F.col("p").isNotNull() & not_sure(F.col("anchor_page") == F.col("p.start_page")), F.lit("invalid_range")),
        F.when(F.col("p").isNotNull() & not_sure(told), F.lit("invalid_lead_metadata")), F.when(not_sure(F.col("note") == NOTE), F.lit("invalid_explanation")),
        F.when(F.col("end_before") + 1 >= F.col("anchor_page"), F.lit("split_continuity")),
    )
    of_groups = rows.select("case_id", F.col("group_id").alias("subject"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return papers.where("rule is not null").unionByName(of_members).unionByName(of_groups).unionByName(inventory_issues(inventory)).distinct()


def papers_told(sides: list[DataFrame]) -> DataFrame:
    """(case_id, n0, a0, b0, n1, ...) of several sides with papers: count and sums of two hashes of a case's papers of each side, in one aggregation.

    They are the same in any order; nulls differ from all values. A side without the columns of INVENTORY is only counted.
    """
    told = [*map(F.col, INVENTORY), *(F.col(c).isNull() for c in INVENTORY)]
    none = F.lit(None).cast("decimal(20,0)")
    rows = None
    for side, df in enumerate(sides):
        marks = [F.xxhash64(*told, F.lit(n)).cast("decimal(20,0)") if set(INVENTORY) <= {*df.columns} else none for n in (1, 2)]
        each = df.select("case_id", F.lit(side).alias("side"), marks[0].alias("a"), marks[1].alias("b"))
        rows = each if rows is None else rows.unionAll(each)
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    sums = [x for s in range(len(sides)) for x in (F.count(of(s, "side")).alias(f"n{s}"), F.sum(of(s, "a")).alias(f"a{s}"), F.sum(of(s, "b")).alias(f"b{s}"))]
    return rows.groupBy("case_id").agg(*sums)


def current_groups(candidate: DataFrame, inventory: DataFrame, members: DataFrame) -> DataFrame:
    """(case_id, group_id, paper_id, role, start_page, end_page, warning) of every case of today's inventory.

    Saved members hold where the saved inventory has just the papers of the candidate one, compared by sums of hashes over their rows, so
    in any order and without sending a paper; else the candidate's papers that have a title stand alone, with a warning whether there
    were no saved groups or stale ones. Cases that only the saved side has are left out.
    """
    cases = papers_told([candidate, inventory, members]).where("n0 > 0")
    same = (F.col("n0") == F.col("n1")) & (F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1"))
    warning = F.when(F.col("n2") == 0, NO_GROUPS).when(not_sure(same), STALE_GROUPS).otherwise("")
    cases = cases.select("case_id", warning.alias("warning"))
    kept = members.join(cases.where("warning = ''"), "case_id").select("case_id", "group_id", "paper_id", "role", "start_page", "end_page", "warning")
    alone = candidate.where("title <> ''").join(cases.where("warning <> ''"), "case_id")
    return kept.unionByName(alone.select("case_id", F.col("paper_id").alias("group_id"), "paper_id", F.lit(ALONE).alias("role"), "start_page", "end_page", "warning"))
