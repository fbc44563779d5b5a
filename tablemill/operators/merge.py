"""Write plans: what replacing, appending or updating by key would do to existing rows.

A plan is one DataFrame, a row for each incoming row (and, for replace, each cleared one), with
`action`, the ids on both sides, the destination row and the reason of a rejection. Keys are
counted with partial counts and joined; destination rows are numbered without gathering rows in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ROW_NUM, ColumnInfo, FrameError, PreparedFrame
from tablemill.functions.conditions import sure
from tablemill.functions.storage import numbered
from tablemill.functions.values import Value
from tablemill.operators.progress import Operation
from tablemill.operators.validate import filled, join_keys

#: Reasons of rejections.
REASONS = {
    "incoming-duplicate-key": "Chave duplicada nos dados de origem.",
    "existing-duplicate-key": "Chave duplicada no destino existente.",
    "missing-update-key": "Chave de atualização ausente.",
}
LAST_SHEET_ROW = 1_048_576


@dataclass
class WritePlan:
    mode: str
    header_row: int
    #: action (clear, insert, update, keep, reject), incomingRowId, existingRowId,
    #: destinationRow, reason
    rows: DataFrame
    incoming: PreparedFrame
    existing: PreparedFrame
    keys: tuple[str, ...] = ()
    data_start_row: int = 1

    @property
    def area(self) -> PreparedFrame:
        """Existing rows of the data area: those above it are never read as data nor written."""
        return data_area(self.existing, self.data_start_row)

    def of(self, action: str) -> DataFrame:
        return self.rows.where(F.col("action") == action)

    @property
    def assignments(self) -> DataFrame:
        """kind, incomingRowId, existingRowId and destinationRow of rows that are written or kept."""
        kept = self.rows.where(F.col("action").isin("insert", "update", "keep"))
        return kept.select(F.col("action").alias("kind"), "incomingRowId", "existingRowId", "destinationRow")

    def duplicates(self) -> DataFrame:
        """scope, keyValues and rowIds (in row order) of keys that stand more than once."""
        both = [(name, f) for name, f in (("incoming", self.incoming), ("existing", self.area)) if self.mode == "update"]
        if not both:
            return self.rows.select(F.lit("").alias("scope"), F.array(F.lit("")).alias("keyValues"), F.array(F.lit("")).alias("rowIds")).limit(0)
        return reduce(DataFrame.unionByName, [repeated_keys(f, self.keys).select(F.lit(n).alias("scope"), "keyValues", "rowIds") for n, f in both])

    def summary(self) -> DataFrame:
        """One row: inserted, updated, kept, cleared, rejected and duplicate keys."""
        n = lambda a: F.count_if(F.col("action") == a)
        counts = self.rows.agg(n("insert").alias("inserted"), n("update").alias("updated"), n("keep").alias("kept"), n("clear").alias("cleared"), n("reject").alias("rejected"))
        return counts.join(self.duplicates().agg(F.count(F.lit(1)).alias("duplicates")), how="cross") if self.mode == "update" else counts.withColumn("duplicates", F.lit(0).cast("long"))

    def apply(self, columns: list[str] | None = None) -> DataFrame:
        """The destination after the plan: columns by id and `destinationRow`. Cleared rows go,
        updated ones take the incoming values, rejected incoming rows are left out; rows above the
        data area stay as they are."""
        ids = columns or self.incoming.ids
        incoming = self.incoming.df.select(F.col(ROW_ID).alias("incomingRowId"), *[F.col(f"`{c}`") for c in ids])
        written = self.rows.where(F.col("action").isin("insert", "update", "keep")).join(incoming, "incomingRowId")
        out = written.select("destinationRow", *[F.col(f"`{c}`") for c in ids])
        touched = self.rows.where("existingRowId is not null and action in ('clear', 'update', 'keep')").select(F.col("existingRowId").alias(ROW_ID))
        rest = self.existing.df.join(touched, ROW_ID, "left_anti")
        have = set(self.existing.ids)
        cast = {c: self.incoming.df.schema[c].dataType for c in ids}
        rest = rest.select(F.col(ROW_NUM).alias("destinationRow"), *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(cast[c]).alias(c) for c in ids])
        return out.unionByName(rest)


def data_area(existing: PreparedFrame, data_start_row: int) -> PreparedFrame:
    return existing.with_df(existing.df.where(F.col(ROW_NUM) >= data_start_row))


def repeated_keys(frame: PreparedFrame, keys: tuple[str, ...]) -> DataFrame:
    order = F.struct(*[F.col(n) for n, _ in frame.order], F.col(ROW_ID).alias("__id"))
    cols = {f"__k{i}": frame.value(c).key for i, c in enumerate(keys)}
    rows = frame.df.where(filled(frame, list(keys))).withColumns(cols)
    groups = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # only rows of repeated keys are listed, under their key: the report itself is as long
    listed = rows.join(groups, list(cols)).groupBy(*cols).agg(F.array_sort(F.collect_list(order)).alias("o"))
    texts = [Value.field(k, listed.schema[k].dataType).text for k in cols]
    return listed.select(F.array(*texts).alias("keyValues"), F.transform("o", lambda x: x["__id"]).alias("rowIds"))


def check_destination(header_row: int, data_start_row: int) -> None:
    if not (isinstance(header_row, int) and isinstance(data_start_row, int) and header_row > 0 and data_start_row > header_row):
        raise FrameError("O destino precisa de linhas positivas, com os dados abaixo do cabeçalho.")


def row(action: str, incoming: Column | None = None, existing: Column | None = None, at: Column | None = None, reason: Column | None = None) -> list[Column]:
    null = F.lit(None)
    return [
        F.lit(action).alias("action"),
        (incoming if incoming is not None else null).cast("string").alias("incomingRowId"),
        (existing if existing is not None else null).cast("string").alias("existingRowId"),
        (at if at is not None else null).cast("long").alias("destinationRow"),
        (reason if reason is not None else null).cast("string").alias("reason"),
    ]


def inserts(frame: PreparedFrame, df: DataFrame, first: int) -> DataFrame:
    return numbered(df, frame.ordering, "__n").select(*row("insert", F.col(ROW_ID), at=F.col("__n") + first))


def plan_write(mode: str, incoming: PreparedFrame, existing: PreparedFrame, header_row: int, data_start_row: int, keys: list[str] | None = None, compare: list[str] | None = None, operation: Operation | None = None) -> WritePlan:
    """keys: key columns of an update. compare: the columns that decide between keep and update
    (default: all that either side has). Within an operation the plan is written, in one step."""
    check_destination(header_row, data_start_row)
    last, unknown = existing.df.agg(F.max(ROW_NUM), F.count_if(F.col(ROW_NUM).isNull())).first()
    if unknown:
        raise FrameError("As linhas existentes precisam de números de linha.")
    area = data_area(existing, data_start_row)
    kept = lambda rows: operation.written("plan", rows) if operation else rows
    plan = lambda rows, *keys: WritePlan(mode, header_row, kept(rows), incoming, existing, keys, data_start_row)
    if mode == "replace":
        clears = area.df.select(*row("clear", existing=F.col(ROW_ID), at=F.col(ROW_NUM)))
        return plan(clears.unionByName(inserts(incoming, incoming.df, data_start_row)))
    first = max(data_start_row - 1, last or 0) + 1
    if mode == "append":
        return plan(inserts(incoming, incoming.df, first))
    if mode != "update":
        raise FrameError(f"Modo de escrita desconhecido: {mode}")
    keys = list(keys or [])
    if not keys or len(set(keys)) != len(keys):
        raise FrameError("A atualização precisa de colunas-chave distintas.")
    return plan(update_rows(incoming, area, first, keys, compare), *keys)


def update_rows(incoming: PreparedFrame, existing: PreparedFrame, first: int, keys: list[str], compare: list[str] | None) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    pair = join_keys([incoming.value(k) for k in keys], [existing.value(k) for k in keys])
    own = [incoming.value(k).column for k in keys] if pair is None else pair[0]
    has = filled(incoming, keys)
    rows = incoming.df.withColumns(dict(zip(names, own))).withColumn("__has", has)
    counts = rows.where("__has").groupBy(*names).agg(F.count(F.lit(1)).alias("__ni"))
    rows = rows.join(counts, names, "left")
    compared = compare or list(dict.fromkeys([*incoming.ids, *existing.ids]))
    if pair is None:
        rows = rows.withColumns({"__ne": F.lit(None).cast("long"), "__eid": F.lit(None).cast("string"), "__erow": F.lit(None).cast("long"), "__same": F.lit(False)})
    else:
        right = {f"__e{i}": existing.value(c).column if c in existing.ids else F.lit(None).cast("string") for i, c in enumerate(compared)}
        held = existing.df.where(filled(existing, keys)).select(*[k.alias(n) for n, k in zip(names, pair[1])], F.col(ROW_ID).alias("__id"), F.col(ROW_NUM).alias("__row"), *[v.alias(k) for k, v in right.items()])
        # of a repeated key one row stands for all: it is rejected whatever its values
        one = held.groupBy(*names).agg(F.count(F.lit(1)).alias("__ne"), F.min_by(F.struct("__id", "__row", *right), F.struct("__row", "__id")).alias("__one"))
        rows = rows.join(one, names, "left").withColumns({"__eid": F.col("__one.__id"), "__erow": F.col("__one.__row")})
        same = F.lit(True)
        for k, c in zip(right, compared):
            a = incoming.value(c) if c in incoming.ids else Value.of(None)
            b = existing.value(c) if c in existing.ids else Value.of(None)
            same = same & sure(a.same(Value(b.kind, F.col(f"__one.{k}"), b.whole)))
        rows = rows.withColumn("__same", same)
    reason = F.when(~F.col("__has"), "missing-update-key").when(F.col("__ni") > 1, "incoming-duplicate-key").when(F.col("__ne") > 1, "existing-duplicate-key")
    rows = rows.withColumn("__reason", reason)
    decided = rows.where("__reason is not null or __eid is not null")
    action = F.when(F.col("__reason").isNotNull(), "reject").when(F.col("__same"), "keep").otherwise("update")
    free = F.col("__reason").isNull()
    decided = decided.select(action.alias("action"), F.col(ROW_ID).alias("incomingRowId"), F.when(free, F.col("__eid")).alias("existingRowId"), F.when(free, F.col("__erow")).alias("destinationRow"), F.col("__reason").alias("reason"))
    new = rows.where("__reason is null and __eid is null").select(*incoming.hidden)
    return decided.unionByName(inserts(incoming, new, first))


def compacted(plan: WritePlan, rejected: DataFrame) -> DataFrame:
    """Assignments without the gaps that rows rejected by validation (rowId) would leave: the
    remaining inserts are numbered anew from the first inserted row."""
    kept = plan.rows.where("action <> 'reject'").join(rejected.select(F.col("rowId").alias("incomingRowId")).distinct(), "incomingRowId", "left_anti")
    first = plan.of("insert").agg(F.min("destinationRow")).first()[0] or 0
    new = numbered(kept.where("action = 'insert'"), [F.col("destinationRow")], "__n")
    return kept.where("action <> 'insert'").unionByName(new.withColumn("destinationRow", F.col("__n") + first).drop("__n"))


def rejected_rows(result, plan: WritePlan | None = None, warnings: bool = False, original: PreparedFrame | None = None) -> DataFrame:
    """Rows of the rejection report: sourceRowNumber, original (fields as text by id), errorField,
    invalidValue, rejectionReason and failedRuleOrTransform; validation first, then the plan.
    original: the frame as imported, where the report should show the values before commands."""
    frame = original or result.frame
    headers = {c.id: c.header for c in result.frame.columns}
    fields = F.create_map(*[x for c in frame.ids for x in (F.lit(c), frame.value(c).text)])
    rows = frame.df.select(F.col(ROW_ID).alias("rowId"), F.col(ROW_NUM).alias("__num"), fields.alias("original"))
    names = F.create_map(*[F.lit(x) for pair in headers.items() for x in pair])
    issues = result.issues if warnings else result.issues.where("severity = 'error'")
    out = issues.join(rows, "rowId", "left").select(
        "sourceRowNumber", "original", F.coalesce(F.try_element_at(names, F.col("columnId")), F.col("columnId")).alias("errorField"),
        F.col("value").alias("invalidValue"), F.col("message").alias("rejectionReason"), F.col("code").alias("failedRuleOrTransform"),
    )
    if plan is None:
        return out
    text = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    keys = [plan.incoming.value(k) for k in plan.keys]
    values = plan.incoming.df.select(F.col(ROW_ID).alias("incomingRowId"), F.to_json(F.array(*[k.text for k in keys]) if keys else F.array()).alias("__v"))
    bad = plan.of("reject").join(values, "incomingRowId").join(rows.withColumnRenamed("rowId", "incomingRowId"), "incomingRowId", "left")
    return out.unionByName(
        bad.select(
            F.coalesce("__num", F.lit(0)).alias("sourceRowNumber"), "original", F.lit(" + ".join(headers.get(k, k) for k in plan.keys)).alias("errorField"),
            F.col("__v").alias("invalidValue"), text[F.col("reason")].alias("rejectionReason"), F.col("reason").alias("failedRuleOrTransform"),
        )
    )


#: The sheet of rejected rows and its headers before and after the original fields.
REJECTED_SHEET = "Registros rejeitados"
REJECTED_HEADERS = ("número da linha de origem",), ("campo com erro", "valor inválido", "motivo da rejeição", "regra/transformação com falha")


def rejected_sheet(result, plan: WritePlan | None = None, warnings: bool = False, original: PreparedFrame | None = None) -> PreparedFrame:
    """The rejection report as a frame that `workbooks` can write (sheet REJECTED_SHEET): the source
    row, a column for each original field, and what was wrong."""
    fields = original or result.frame
    rows = rejected_rows(result, plan, warnings, original)
    before, after = REJECTED_HEADERS
    names = ["sourceRowNumber", *[f"original.{c}" for c in fields.ids], "errorField", "invalidValue", "rejectionReason", "failedRuleOrTransform"]
    headers = [*before, *[c.header for c in fields.columns], *after]
    cells = [F.col("sourceRowNumber").cast("long"), *[F.try_element_at("original", F.lit(c)) for c in fields.ids], *[F.col(c) for c in names[-4:]]]
    df = rows.select(*[c.alias(n) for c, n in zip(cells, names)])
    # a rejected row may stand several times, so the report's order decides its ids
    df = numbered(df, [F.col("sourceRowNumber"), F.col("errorField"), F.col("failedRuleOrTransform"), F.col("invalidValue")], ROW_NUM)
    infos = tuple(ColumnInfo(n, h, i, "number" if not i else "string") for i, (n, h) in enumerate(zip(names, headers)))
    hidden = [F.concat(F.lit("rejected-"), F.col(ROW_NUM).cast("string")).alias(ROW_ID), F.col(ROW_NUM), F.col(ROW_NUM).alias("_o0")]
    return PreparedFrame(df.select(*[F.col(f"`{n}`") for n in names], *hidden), infos, (("_o0", True),))


def effective_counts(result, plan: WritePlan) -> DataFrame:
    """One row: inserted, updated and kept rows that validation does not reject, duplicateRows (rows
    of repeated keys on either side) and rejectedRows (by validation or the plan)."""
    bad = result.issues.where("severity = 'error'").select(F.col("rowId").alias("incomingRowId")).distinct().withColumn("bad", F.lit(True))
    rows = plan.rows.where("incomingRowId is not null").select("action", "incomingRowId").join(bad, "incomingRowId", "full")
    n = lambda a: F.count_if((F.col("action") == a) & F.col("bad").isNull())
    counts = rows.agg(n("insert").alias("inserted"), n("update").alias("updated"), n("keep").alias("kept"), F.count_if((F.col("action") == "reject") | F.col("bad").isNotNull()).alias("rejectedRows"))
    if plan.mode != "update":
        return counts.withColumn("duplicateRows", F.lit(0).cast("long"))
    twice = [repeated_counts(f, plan.keys) for f in (plan.incoming, plan.area)]
    return counts.join(twice[0].unionByName(twice[1]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicateRows")), how="cross")


def repeated_counts(frame: PreparedFrame, keys: tuple[str, ...]) -> DataFrame:
    """n: rows of each key that stands more than once."""
    return frame.df.where(filled(frame, list(keys))).groupBy(*[frame.value(c).key.alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n")


def row_counts(result, plan: WritePlan) -> DataFrame:
    """One row: total, errorRows, planRejectedRows, rejectedRows (either) and exportableRows."""
    bad = result.issues.where("severity = 'error'").select("rowId").distinct().withColumn("e", F.lit(1))
    refused = plan.of("reject").select(F.col("incomingRowId").alias("rowId")).distinct().withColumn("p", F.lit(1))
    rows = result.frame.df.select(F.col(ROW_ID).alias("rowId")).join(bad, "rowId", "left").join(refused, "rowId", "left")
    either = F.col("e").isNotNull() | F.col("p").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("e").alias("errorRows"), F.count("p").alias("planRejectedRows"), F.count_if(either).alias("rejectedRows"), F.count_if(~either).alias("exportableRows"))


def preview(result, view: str, rule: str | None = None, severity: str | None = None) -> DataFrame:
    """Rows with issues (errors), without any (valid), or all; by rule and severity if given."""
    issues = result.issues
    issues = issues.where(F.col("ruleId") == rule) if rule else issues
    issues = issues.where(F.col("severity") == severity) if severity else issues
    ids = issues.select(F.col("rowId").alias(ROW_ID)).distinct()
    if view == "all":
        return result.frame.df
    return result.frame.df.join(ids, ROW_ID, "left_semi" if view == "errors" else "left_anti")


def issues_by_cell(result) -> DataFrame:
    """rowId, columnId, how many issues and their codes."""
    return result.issues.groupBy("rowId", "columnId").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("code")).alias("codes"))


#: What XML 1.0 cannot hold, as a Java pattern.
FORBIDDEN = r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"


def value_risks(plan: WritePlan, columns: list[str] | None = None) -> DataFrame:
    """What would go wrong in writing a plan to a sheet, before it is written: code, columnId (null for whole rows),
    how many rows have it (`n`) and the first of their destination rows (`firstRow`). One join of the written rows with their
    values and one aggregate, however many columns there are."""
    ids = columns or plan.incoming.ids
    values = plan.incoming.df.select(F.col(ROW_ID).alias("incomingRowId"), *[F.col(f"`{c}`") for c in ids])
    rows = plan.rows.where(F.col("action").isin("clear", "insert", "update")).join(values, "incomingRowId", "left")
    at, given = F.col("destinationRow"), F.col("action").isin("insert", "update")
    found = [("write-outside-data-rows", None, at.isNull() | (at < plan.data_start_row)), ("write-row-exceeds-excel-limit", None, at > LAST_SHEET_ROW)]
    for c in ids:
        v = plan.incoming.value(c)
        found.append(("non-finite-cell-value", c, given & (F.isnan(v.number) | (F.abs(v.number) == float("inf")))))
        found.append(("forbidden-xml-character", c, given & v.string.rlike(FORBIDDEN)))
    said = [F.struct(F.lit(code).alias("code"), F.lit(c).cast("string").alias("columnId"), F.count_if(sure(bad)).alias("n"), F.min(F.when(sure(bad), at)).alias("firstRow")) for code, c, bad in found]
    return rows.agg(F.array(*said).alias("said")).select(F.inline("said")).where("n > 0")
