"""Set-based change application.

The reference edits one row per HTTP call.  Here a table of changes is
applied to a snapshot in one job: change tables are reduced to one row
per key with a partial max-aggregation, then combined with the base by
anti-join + union, so no step sorts or windows a whole key group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import ordered, segmented


def _replayed(changes: DataFrame, keys: list[str], cols: list[str], seq: str, op: str) -> DataFrame:
    """What all changes of a key come to, in order of (``seq``, ``op``, other
    columns): ``_row`` (the last 'I' or 'U'), ``_i`` and ``_d`` (the places
    of the last 'I' and the last 'D').  Three partial aggregates, so no
    key's changes are gathered or sorted."""
    place = F.struct(F.col(seq).alias("seq"), F.col(op).alias("op"))
    row = F.struct(F.col(seq), F.col(op), *[F.col(c) for c in cols])
    return changes.groupBy(*keys).agg(
        F.max(F.when(F.col(op).isin("I", "U"), row)).alias("_row"),
        F.max(F.when(F.col(op) == "I", place)).alias("_i"),
        F.max(F.when(F.col(op) == "D", place)).alias("_d"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str | list[str], seq: str = "seq",
                  op: str = "op") -> DataFrame:
    """New snapshot after insert ('I'), update ('U') and delete ('D')
    changes, applied one after another in order of ``seq`` (equal ``seq``:
    'D' before 'I' before 'U').

    'U' changes only a row that exists at that point (an UPDATE of a
    missing row does nothing); 'I' of an existing key replaces it; 'D'
    removes it.  So a key ends up present if its last 'I' comes after its
    last 'D', or if it has neither and is in ``base``; its row is then that
    of its last 'I' or 'U'."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in base.columns if c not in keys]
    last = _replayed(changes, keys, cols, seq, op)
    # Which changed keys exist in the base.  The base's keys are semi-joined
    # with the changed keys (small in the usual case, so AQE broadcasts
    # them and the base is streamed, never shuffled).
    present = (base.select(*keys).join(last.select(*keys), keys, "left_semi").distinct()
               .withColumn("_in_base", F.lit(True)))
    flagged = last.join(present, keys, "left")
    lives = F.when(F.col("_i").isNotNull(), F.col("_d").isNull() | (F.col("_i") > F.col("_d"))).otherwise(
        F.col("_d").isNull() & F.col("_in_base").isNotNull())
    new_rows = flagged.where(lives & F.col("_row").isNotNull()).select(
        *keys, *[F.col("_row")[c].alias(c) for c in cols])
    # The base itself is only anti-joined with the changed keys; when the
    # change set is small AQE broadcasts it and the base is never shuffled.
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(new_rows.select(*base.columns))


def change_report(base: DataFrame, changes: DataFrame, key: str | list[str], seq: str = "seq",
                  op: str = "op") -> DataFrame:
    """The row each effective change returns (``RETURNING *``), with its
    ``seq``: the new row for I/U, the removed row for D.  Changes that touch
    nothing (U or D of a key that is missing at that point) return none.

    Changes are applied in order, as in ``apply_changes``: whether a key
    exists before a change follows from the last I or D before it, else
    from the base, and the row that a D removes is that of the last I or U
    before it, else the base's."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in base.columns if c not in keys]
    order = [F.col(seq), F.col(op), *[F.col(c) for c in cols]]
    row = F.struct(*[F.col(c) for c in cols])
    was, shown = F.when(F.col(op).isin("I", "D"), F.col(op)), F.when(F.col(op).isin("I", "U"), row)
    rows = changes.select(*keys, seq, op, *cols).withColumn(segmented.SEGMENT, segmented.segment(changes, seq))
    # the last I or D, and the last row shown, of each segment of a key's changes; then of all segments before it
    place = F.struct(*order)
    ends = rows.groupBy(*keys, segmented.SEGMENT).agg(
        F.max(F.when(was.isNotNull(), place))[op].alias("_was"), F.max(F.when(shown.isNotNull(), F.struct(place, row.alias("row"))))["row"].alias("_shown"))
    earlier = Window.partitionBy(*keys).orderBy(F.col(segmented.SEGMENT).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(*keys, segmented.SEGMENT, *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in ("_was", "_shown")])
    both = segmented.with_edges(rows.withColumns({"_was": was, "_shown": shown}),
                                edges.where("_was IS NOT NULL OR _shown IS NOT NULL"))
    before = segmented.in_segments(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    ch = both.select(*keys, seq, op, *cols, segmented.EDGE,
                     *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("_was", "_shown")])
    ch = ch.where(f"{segmented.EDGE} = 1").drop(segmented.EDGE)
    # only the base rows of changed keys take part in the join
    touched = base.join(changes.select(*keys).distinct(), keys, "left_semi")
    b = touched.select(*keys, F.struct(*[F.col(c) for c in cols]).alias("_old"), F.lit(True).alias("_in_base"))
    j = ch.join(b, keys, "left")
    exists = F.when(F.col("_was").isNull(), F.col("_in_base").isNotNull()).otherwise(F.col("_was") == "I")
    gone = F.coalesce("_shown", "_old")
    shown = [F.when(F.col(op) == "D", gone[c]).otherwise(F.col(c)).alias(c) for c in cols]
    return j.where((F.col(op) == "I") | (F.col(op).isin("U", "D") & exists)).select(F.col(op), F.col(seq), *keys, *shown)


def update_keep_blank(base: DataFrame, changes: DataFrame, key: str | list[str], cols: list[str],
                      keep_if_blank: list[str], seq: str | None = None) -> DataFrame:
    """UPDATE of existing rows: ``cols`` take the new value, except that a
    blank or NULL new value in a ``keep_if_blank`` column keeps the old one.
    Rows without a change are unchanged; changes to missing keys do nothing.
    Several changes of one key are applied in order of ``seq`` (without
    ``seq``: of the row), so a ``keep_if_blank`` column ends with the last
    value that was not blank."""
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*([F.col(seq).alias("_seq")] if seq else []), *[F.col(c).alias("_" + c) for c in cols])
    ch = changes.groupBy(*keys).agg(F.max(row).alias("_last"), *[
        F.max(F.when(C.blank_to_null(c).isNotNull(), row))["_" + c].alias("_kept_" + c) for c in keep_if_blank])
    j = base.join(ch, keys, "left")
    out = []
    for c in base.columns:
        if c in keep_if_blank:
            out.append(F.coalesce(C.blank_to_null("_kept_" + c), F.col(c)).alias(c))
        elif c in cols:
            out.append(F.when(F.col("_last").isNotNull(), F.col("_last")["_" + c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def insert_ignore(base: DataFrame, new: DataFrame, key: str | list[str], seq: str | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING``: new rows whose unique key is
    absent from ``base`` are appended; among new rows repeating a key the
    first (smallest ``seq``) is kept.  A key with a NULL conflicts with
    nothing, as SQL UNIQUE does, so all rows with one are appended."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in new.columns if c not in keys]
    order = [F.col(seq)] if seq else []
    first = F.min(F.struct(*order, *[F.col(c) for c in rest if c != seq])).alias("_b")
    whole = C.all_of([F.col(k).isNotNull() for k in keys])
    firsts = new.where(whole).groupBy(*keys).agg(first)
    firsts = firsts.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest if c != seq or c in base.columns])
    # base keys that collide with a new row (the new rows are usually few,
    # so they are broadcast and the base is streamed)
    taken = base.select(*keys).join(firsts.select(*keys), keys, "left_semi").distinct()
    fresh = firsts.join(taken, keys, "left_anti")
    return (base.unionByName(fresh.select(*base.columns))
            .unionByName(new.where(~whole).select(*base.columns)))


def replace_links(bridge: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """Replace the whole link set of every parent present in ``new`` (or
    listed in ``touched``, which lets a parent's set become empty)."""
    parents = new.select(parent)
    if touched is not None:
        parents = parents.unionByName(touched.select(parent))
    parents = parents.distinct()
    kept = bridge.join(parents, parent, "left_anti")
    return kept.unionByName(new.select(*bridge.columns).distinct())


def _columns(c: str | list[str] | tuple[str, ...]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def cascade_delete(tables: dict[str, DataFrame], fks: list[tuple], root: str,
                   ids: DataFrame) -> dict[str, DataFrame]:
    """Delete ``ids`` (columns named like the root's key) from ``root`` and,
    following ``fks`` = [(child, child_cols, parent, parent_cols)] (names or
    lists of names), every dependent row (``ON DELETE CASCADE``).  Returns
    the new tables.

    A child row goes because a foreign key of it points at a removed row,
    so each table is anti-joined on those foreign-key columns, whatever its
    own key is (link tables have keys of several columns).  Parents are
    done before children; each level is a join with the distinct referenced
    values of the parent's removed rows (usually a small, broadcastable
    set).  A NULL foreign key points at nothing.  Foreign keys in a cycle
    raise."""
    links = [(child, _columns(cc), parent, _columns(pc)) for child, cc, parent, pc in fks]
    order, todo = [], set(tables)
    while todo:
        ready = sorted(t for t in todo if not any(c == t and p in todo for c, _, p, _ in links))
        if not ready:
            raise ValueError(f"foreign keys form a cycle among {sorted(todo)}")
        order += ready
        todo -= set(ready)
    by_root = ids.select(*ids.columns).distinct()
    removed = {root: tables[root].join(by_root, ids.columns, "left_semi")}
    out = dict(tables)
    out[root] = tables[root].join(by_root, ids.columns, "left_anti")
    for t in order:
        if t == root:
            continue
        for child, ccols, parent, pcols in links:
            if child != t or parent not in removed:
                continue
            refs = removed[parent].select(*[F.col(p).alias(c) for p, c in zip(pcols, ccols, strict=True)])
            refs = refs.dropna().distinct()
            gone = out[t].join(refs, ccols, "left_semi")
            removed[t] = removed[t].unionByName(gone) if t in removed else gone
            out[t] = out[t].join(refs, ccols, "left_anti")
    return {t: df.select(*tables[t].columns) for t, df in out.items()}


def mark_arrival(foot: DataFrame, arrivals: DataFrame, as_of, user: str = "usuario_id",
                 building: str = "edificio_id", time: str = "llegada", searched: str = "fecha_busqueda") -> DataFrame:
    """Set ``tiempo_llegada`` and ``mensaje_enviado`` on every footprint row
    of a (user, building) that arrived; the latest arrival wins and an
    arrival without a time uses ``as_of``.  An arrival marks only rows that
    were there then: those searched later stay as they are (a row without
    a search time counts as there)."""
    t = F.coalesce(F.col(time), F.lit(as_of).cast("timestamp_ntz"))
    a = arrivals.groupBy(user, building).agg(F.max(t).alias("_t"))
    j = foot.join(a, [user, building], "left")
    prev_t = F.col("tiempo_llegada") if "tiempo_llegada" in foot.columns else F.lit(None).cast("timestamp_ntz")
    prev_m = F.col("mensaje_enviado") if "mensaje_enviado" in foot.columns else F.lit(False)
    cols = [c for c in foot.columns if c not in ("tiempo_llegada", "mensaje_enviado")]
    marks = F.col("_t").isNotNull()
    if searched in foot.columns:
        marks &= F.col(searched).isNull() | (F.col("_t") >= F.col(searched))
    return j.select(*cols,
                    F.when(marks, F.col("_t")).otherwise(prev_t).alias("tiempo_llegada"),
                    F.when(marks, F.lit(True)).otherwise(F.coalesce(prev_m, F.lit(False)))
                    .alias("mensaje_enviado"))


def passenger_state(board: DataFrame, alight: DataFrame, pid: str = "id_pasajero") -> DataFrame:
    """Boarded rows are 'A BORDO'; those with an alighting record become
    'BAJADO'."""
    off = alight.select(pid).where(F.col(pid).isNotNull()).distinct().withColumn("_off", F.lit(True))
    j = board.join(off, pid, "left")
    cols = [c for c in board.columns if c != "estado"]
    return j.select(*cols, F.when(F.col("_off"), F.lit("BAJADO")).otherwise(F.lit("A BORDO")).alias("estado"))


def passengers_on_board(state: DataFrame, bus: str = "id_bus") -> DataFrame:
    return (state.where(F.col("estado") == "A BORDO").groupBy(bus)
            .agg(F.count(F.lit(1)).alias("a_bordo")).orderBy(C.asc_pg(bus)))


def assign_ids(df: DataFrame, order: list[str], out: str = "id", start_after: DataFrame | int = 0,
               existing_key: str | None = None) -> DataFrame:
    """Sequential ids after the current maximum (``SERIAL``), in ``order``.

    Numbering uses the range-partitioned global order (per-range counts
    plus prefix offsets), not one window over all rows."""
    numbered = ordered.global_row_number(df, [F.col(c).asc_nulls_last() for c in order], set(order), out="_rn")
    if isinstance(start_after, DataFrame):
        top = start_after.agg(F.coalesce(F.max(existing_key or out), F.lit(0)).cast("long").alias("_start"))
        return numbered.withColumn(out, top.scalar() + F.col("_rn")).drop("_rn")
    return numbered.withColumn(out, F.lit(int(start_after)) + F.col("_rn")).drop("_rn")


def add_column_default(df: DataFrame, name: str, dtype: str, value) -> DataFrame:
    """``ALTER TABLE ... ADD COLUMN name dtype DEFAULT value``."""
    return df.withColumn(name, F.lit(value).cast(dtype))


def fill_defaults(df: DataFrame, defaults: dict, as_of=None) -> DataFrame:
    """Column defaults for missing values; the value ``"now"`` stands for
    ``CURRENT_TIMESTAMP`` and is replaced by ``as_of``."""
    def lit(v):
        if v == "now":
            return F.lit(as_of).cast("timestamp_ntz")
        return F.lit(v)
    return df.select(*[F.coalesce(F.col(c), lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                       for c in df.columns])


def issue_weekly_codes(rooms: DataFrame, first_week, weeks: int, room: str = "id_aula") -> DataFrame:
    """For every classroom and each of ``weeks`` weeks from ``first_week``,
    a code valid 7 days.  The reference draws a random code; here it is
    the SHA-256 of (room, week), so re-running gives the same codes.  Each
    room row generates its own ``weeks`` rows (no join)."""
    start = F.lit(first_week).cast("date")
    weeks_col = F.sequence(start, F.date_add(start, 7 * (int(weeks) - 1)), F.expr("INTERVAL 7 DAYS"))
    r = rooms.select(room).where(F.col(room).isNotNull()).distinct()
    out = r.select(room, F.explode(weeks_col).alias("semana"))
    code = F.sha2(F.concat_ws("|", F.col(room).cast("string"), F.col("semana").cast("string")), 256)
    return out.select(room, "semana", code.alias("codigo_qr"),
                      F.col("semana").cast("timestamp_ntz").alias("fecha_inicio"),
                      F.date_add(F.col("semana"), 7).cast("timestamp_ntz").alias("fecha_fin"))
