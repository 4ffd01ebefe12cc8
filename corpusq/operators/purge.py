"""S22. A guarded purge of the foreign parts of books, over tables in versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept_lines, written
from ..sources.versions import Versions


def region(audit: DataFrame, **tables: DataFrame) -> DataFrame:
    """(book, boundary, and for each table the rows that can be deleted) of the books whose foreign part is pure."""
    out = audit.where("pure").select("book", "boundary")
    for name, rows in tables.items():
        inside = rows.select("book", "page").join(out.select(F.col("book").alias("b"), F.col("boundary").alias("from")), (F.col("book") == F.col("b")) & (F.col("page") >= F.col("from")))
        out = out.join(inside.groupBy(F.col("book").alias("of")).agg(F.count(F.lit(1)).alias(name)), F.col("book") == F.col("of"), "left").drop("of").fillna(0, [name])
    return out


def purge(versions: Versions, audit: Callable[[DataFrame], DataFrame], chunks: str = "chunks", figures: str = "figures", captions: str = "captions") -> dict:
    """Delete the pure foreign part of each book from chunks and figures (book, page; figures also id), and lines of its figures from
    captions (book, line), as one version. The version before is the backup: it stays readable, and rollback() goes back to it.

    Returns the state: clean (nothing to delete: no version is made), impure (nothing, but books that are contaminated
    otherwise are there; they are never touched), purged, or dirty (the audit of what was written still finds rows); the versions
    before and after; and how much was deleted. It can be run again at any time; a run that is lost has changed nothing."""
    base = versions.latest()
    rows, plates = versions.read(chunks, base), versions.read(figures, base)
    found = written(audit(rows), "audit")
    cut = written(region(found, chunks=rows, figures=plates), "region")
    total = cut.agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("figures"), F.lit(0))).first()
    impure = found.where(~F.col("pure")).count()
    state = {"backup": base, "version": base, "chunks": total[0], "figures": total[1], "captions": 0, "impure": impure}
    if not total[0] + total[1]:
        return state | {"state": "impure" if impure else "clean"}
    touched = cut.where("chunks + figures > 0").select(F.col("book").alias("b"), "boundary")
    tables = versions.entry(base)["tables"]

    def without(name: str, table: DataFrame) -> list[dict]:
        """The table's parts and one that holds what stays of the touched books."""
        stays = table.join(touched, F.col("book") == F.col("b")).where("page < boundary").select(*table.columns)
        return [*tables[name], versions.write_part(stays, max(p["seq"] for p in tables[name]) + 1, touched.select(F.col("b").alias("book")))]

    after = {chunks: without(chunks, rows), figures: without(figures, plates)}
    lines = versions.read(captions, base)
    if lines is not None:
        gone = plates.join(touched, F.col("book") == F.col("b")).where("page >= boundary").select("id").distinct()
        kept = kept_lines(lines, gone)
        part = versions.write_part(kept, max(p["seq"] for p in tables[captions]) + 1)
        state["captions"] = lines.count() - versions.spark.read.parquet(f"{versions.folder(part)}/rows").count()
        after[captions] = [part]
    version = versions.commit(base, after, {"purged_from": base})
    again = region(audit(versions.read(chunks, version)), chunks=versions.read(chunks, version), figures=versions.read(figures, version)).where("chunks + figures > 0")
    return state | {"version": version, "state": "purged" if again.isEmpty() else "dirty"}
