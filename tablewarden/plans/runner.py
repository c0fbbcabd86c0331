"""A check run: from registry and tables to result rows.

The registry is read to the driver, it is configuration: a row per check, never
per inspected row. What comes out is one DataFrame in which all row checks of a
table share a scan and every other check is an aggregate of its own.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.moments import ISO_BASIC, moment, utc_now
from tablewarden.functions.outputs import parse_setup_outputs
from tablewarden.functions.variables import as_prior, merge_vars
from tablewarden.operators.catalogue import BUILT_IN, Catalogue, Check, CheckContext, CheckMemory
from tablewarden.operators.fused import count_by_day, count_violations
from tablewarden.plans.registry import valid_entries
from tablewarden.schema import (
    CHECK_CUSTOM_PREFIX,
    NO_COUNT,
    RC_BAD_CHECK_OUTPUT,
    RC_BAD_SETUP_OUTPUT,
    RESULT_SCHEMA,
    TABLE_CUSTOM_PREFIX,
    TABLE_PREFIX,
    VAR_PREFIX,
)
from tablewarden.sources.partitions import PartitionResults, totals
from tablewarden.sources.results import commit_results, read_results
from tablewarden.streaming import latest
from tablewarden.streaming.incremental import DataWindow
from tablewarden.streaming.ledger import Ledger, day_column

log = logging.getLogger(__name__)

#: One job has at most so many branches (scans, checks of their own, setups); the
#: plan of a large registry would otherwise take longer than its checks.
BRANCHES = 25
#: Fewer are not worth a job, and a commit, of their own.
LEAST_BRANCHES = 4
#: So many jobs of a run are planned and executed side by side, each in a scheduler pool of its own.
PARALLEL = 4

#: A check by partition keeps its worst partitions among its variables, so many at most, and the number of all.
WORST_PARTITIONS = 100
PARTITION_VAR, PARTITIONS_VAR = f"{VAR_PREFIX}partition_", f"{VAR_PREFIX}partitions"

#: What checks keep from run to run lies here, beside the history.
MEMORY_FOLDER = "_checks"

#: A failed check keeps the beginning of what was wrong under this variable.
ERROR_VAR = f"{VAR_PREFIX}error"
ERROR_LENGTH = 500

#: Where the table's window ended, as results keep it among their variables.
STOP_VAR = f"{TABLE_PREFIX}_data_stop_ts"

#: Signs that the cluster or its storage failed, not the check.
OUTAGES = ("FAILED_READ_FILE", "java.io.IOException", "java.net.", "org.apache.hadoop.", "ExecutorLost")

CHECK_PROPERTIES = (
    "key string, table_name string, check_name string, check_type string, "
    "check_policy_type string, check_unit string, check_status string, planned_mode string, "
    "window_start timestamp_ntz, window_stop timestamp_ntz, env_vars map<string,string>"
)


@dataclass(frozen=True)
class Run:
    """Who runs what, and when it began."""

    instance: str
    database: str
    #: unless given, the microseconds from 1970 to the start: no two runs share it
    run_id: int | None = None
    started: dt.datetime = field(default_factory=utc_now)
    ssl: str = ""

    def __post_init__(self) -> None:
        if self.run_id is None:
            since = self.started - dt.datetime(1970, 1, 1)
            object.__setattr__(self, "run_id", since // dt.timedelta(microseconds=1))

    def vars(self) -> dict[str, str]:
        return {
            f"{VAR_PREFIX}instance": self.instance,
            f"{VAR_PREFIX}database": self.database,
            f"{VAR_PREFIX}ssl": self.ssl,
        }


@dataclass(frozen=True, eq=False)
class Planned:
    """One check about to run: a predicate or aggregate of ``df``, or ``df`` itself."""

    entry: Row
    check: Check
    df: DataFrame
    body: Column | None
    mode: str
    saved_vars: dict[str, str]
    window: tuple[dt.datetime | None, dt.datetime | None]
    scan: tuple
    later: Callable[[], DataFrame] | None = None


@dataclass
class TableState:
    """What the setup checks of a table established."""

    status: str = "active"
    mode: str = ""
    start: dt.datetime | None = None
    stop: dt.datetime | None = None
    vars: dict[str, str] = field(default_factory=dict)
    failed: bool = False
    #: when the latest setup that succeeded before ran
    since: dt.datetime | None = None
    #: days that got rows after they had been inspected, and when that was found
    late: list[tuple[dt.date, dt.datetime]] = field(default_factory=list)


@dataclass(frozen=True)
class Remembered:
    """What the history says of one check: of a setup its variables, of others how far they got."""

    prior: dict[str, str] = field(default_factory=dict)
    tried: bool = False
    last_stop: dt.datetime | None = None
    last_run: dt.datetime | None = None
    set_up: dt.datetime | None = None


def _clean(value: object) -> str:
    text = "" if value is None else str(value)
    return "" if text.strip().lower() == "none" else text


def _custom_vars(entry: Row) -> dict[str, str]:
    given = {k: _clean(v) for k, v in (entry.custom or {}).items()}
    own = {k: v for k, v in given.items() if k.startswith(CHECK_CUSTOM_PREFIX)}
    return own | {f"{VAR_PREFIX}check_mode": _clean(entry.check_mode)}


def _result(run: Run, entry: Row, **values) -> Row:
    base = dict.fromkeys(RESULT_SCHEMA.fieldNames())
    base.update(
        instance_name=run.instance,
        database_name=run.database,
        table_name=entry.table_name,
        check_name=entry.check_alias,
        check_type=entry.check_type,
        check_policy_type="quality",
        check_mode="",
        check_unit="rows",
        check_status=entry.check_status,
        run_id=run.run_id,
        run_start_timestamp=run.started,
        run_stop_timestamp=utc_now(),
        check_rc=0,
        check_scope=float(NO_COUNT),
        check_severity_score=NO_COUNT,
        env_vars={},
    )
    return Row(**(base | values))


def _batches(items: list) -> list[list]:
    return [items[i : i + BRANCHES] for i in range(0, len(items), BRANCHES)]


def _failed(run: Run, entry: Row, error: object) -> Row:
    log.warning("%s.%s failed: %s", entry.table_name, entry.check_alias, error)
    return _result(
        run,
        entry,
        check_rc=RC_BAD_CHECK_OUTPUT,
        check_violation_cnt=NO_COUNT,
        env_vars={ERROR_VAR: str(error)[:ERROR_LENGTH]},
    )


def _is_outage(error: Exception) -> bool:
    return any(sign in str(error) for sign in OUTAGES)


class RunPlan:
    """The checks of one run, planned but not executed (setups have been)."""

    def __init__(
        self,
        spark: SparkSession,
        registry: DataFrame,
        tables: Mapping[str, DataFrame],
        run: Run,
        history: DataFrame | None = None,
        user_vars: Mapping[str, str] | None = None,
        catalogue: Catalogue = BUILT_IN,
        path: str | None = None,
    ) -> None:
        """``path`` is where the history lies; beside it the run keeps days, partitions and what checks remember."""
        self.spark, self.tables, self.run, self.catalogue = spark, tables, run, catalogue
        self.path, self.history = path and path.rstrip("/"), history
        self.user_vars = {
            k: _clean(v) for k, v in (user_vars or {}).items() if k.startswith(TABLE_PREFIX)
        }
        entries = valid_entries(registry, catalogue.checks)
        #: rows known without running a check: setups, inactive and unplannable checks
        self.done: list[Row] = []
        #: checks still to be executed
        self.planned: list[Planned] = []
        self._frames: dict[tuple, DataFrame] = {}
        self._memory: dict[tuple[str, str], Remembered] = {}
        self._profiled: dict[str, dt.datetime] | None = None
        self._recall(history, entries)
        states = self._run_setups([e for e in entries if e.check_type == "setup"])
        self._note_days(states)
        for entry in entries:
            if entry.check_type in ("setup", "teardown"):
                continue
            state = states.get(entry.table_name, TableState())
            if state.status == "inactive":
                continue
            if entry.check_status == "inactive":
                self.done.append(
                    _result(
                        run, entry, check_rc=NO_COUNT, check_violation_cnt=NO_COUNT, check_mode="full"
                    )
                )
                continue
            try:
                self.planned.append(self._plan(entry, state))
            except Exception as e:  # whatever is wrong with one check is that check's result
                self.done.append(_failed(run, entry, e))
        self._analyse()

    # -- setups --------------------------------------------------------------

    def _context(
        self, table: str, df: DataFrame, known: dict[str, str],
        window: DataWindow | None = None, memory: CheckMemory | None = None,
    ) -> CheckContext:
        return CheckContext(
            self.spark, table, df, self.tables, known, self._profiled, self.run.started, window, memory
        )

    def _check_memory(self, entry: Row) -> CheckMemory | None:
        if self.path is None:
            return None
        place = [self.run.instance, self.run.database, entry.table_name, entry.check_alias]
        folder = hashlib.sha256(json.dumps(place).encode()).hexdigest()[:32]

        mine = None
        if self.history is not None:
            mine = self.history.where(
                (F.col("instance_name") == place[0])
                & (F.col("database_name") == place[1])
                & (F.col("table_name") == place[2])
                & (F.col("check_name") == place[3])
            )

        def committed(runs: list[str]) -> set[str]:
            """Those of some runs, few as they are, in which this check was counted."""
            if not runs or mine is None:
                return set()
            counted = mine.where((F.col("check_violation_cnt") >= 0) & F.col("run_id").cast("string").isin(runs))
            return {str(r.run_id) for r in counted.select("run_id").distinct().collect()}

        return CheckMemory(f"{self.path}/{MEMORY_FOLDER}/{folder}", str(self.run.run_id), committed, mine)

    def _note_days(self, states: dict[str, TableState]) -> None:
        """Enter the days of tables with a data window in the ledger, and learn which got rows late."""
        if self.path is None:
            return
        ledger, run = Ledger(self.spark, self.path), self.run
        for table, state in states.items():
            column = state.vars.get(f"{TABLE_CUSTOM_PREFIX}window_col")
            if state.failed or state.mode != "incremental" or state.stop is None or not column:
                continue
            form = state.vars.get(f"{TABLE_CUSTOM_PREFIX}window_form") or "yyyyDDD"
            back = state.vars.get(f"{TABLE_CUSTOM_PREFIX}look_back_days", "")
            try:
                ledger.note(
                    run, table, self.tables[table], column, form, state.start, state.stop, int(back) if back.strip() else None
                )
                if state.start is not None:
                    counted = [m.last_run for (t, _), m in self._memory.items() if t == table and m.last_run]
                    state.late = ledger.late_days(run.instance, run.database, table, min(counted, default=None))
            except Exception as e:
                if _is_outage(e):
                    raise
                log.warning("the days of %s could not be told: %s", table, e)
                state.failed = True

    def _recall(self, history: DataFrame | None, entries: list[Row]) -> None:
        """All that a run needs of its history, in one aggregation: a row per check comes back.

        Of setups the variables of the latest successful run, of incremental checks the end of the
        latest window they were counted in, of profiles their date.
        """
        if history is None or not entries:
            return
        mine = history.where(
            (F.col("instance_name") == self.run.instance)
            & (F.col("database_name") == self.run.database)
            & F.col("table_name").isin(sorted({e.table_name for e in entries}))
        )
        if self.path is None:
            facts = latest.merged(latest.facts_of(mine, STOP_VAR))
        else:
            facts = latest.Snapshots(self.spark, self.path, self.run.instance, self.run.database).facts(mine, STOP_VAR)
            facts = facts.where(F.col("table_name").isin(sorted({e.table_name for e in entries})))
        self._profiled = {}
        for row in facts.withColumn("prior", as_prior(F.col("saved"))).collect():
            prior = {k: _clean(v) for k, v in (row.prior or {}).items()}
            set_up = row.saved_at.at if row.saved_at else None
            memory = Remembered(prior, bool(row.tried), row.last_stop, row.last_run, set_up)
            self._memory[row.table_name, row.check_name] = memory
            if row.profiled is not None:
                known = self._profiled.get(row.table_name, row.profiled)
                self._profiled[row.table_name] = max(known, row.profiled)

    def _remembered(self, entry: Row) -> Remembered:
        return self._memory.get((entry.table_name, entry.check_alias), Remembered())

    def _run_setups(self, setups: list[Row]) -> dict[str, TableState]:
        """Run the setups and read back their variables, a row per setup."""
        states: dict[str, TableState] = {}
        active = [e for e in setups if e.check_status == "active"]
        if not active:
            return states
        outputs: list[DataFrame] = []
        for i, entry in enumerate(active):
            known = self.run.vars() | {f"{TABLE_PREFIX}": entry.table_name}
            known |= self._remembered(entry).prior | _custom_vars(entry)
            try:
                ctx = self._context(entry.table_name, self.tables[entry.table_name], known)
                raw = self.catalogue.checks[entry.check_name].body(ctx)
                if not isinstance(raw, DataFrame):
                    raw = self.spark.range(1).select(F.lit(json.dumps(raw)).alias("raw_output"))
                # one row comes back whatever the setup returns; several are no output
                text = F.when(F.count(F.lit(1)) == 1, F.max(F.col("raw_output").cast("string")))
                raw = raw.agg(text.alias("raw_output"))
            except Exception as e:
                log.warning("%s.%s failed: %s", entry.table_name, entry.check_alias, e)
                raw = self.spark.range(1).select(F.lit(None).cast("string").alias("raw_output"))
            outputs.append(raw.select(F.lit(i).alias("i"), "raw_output", F.lit(0).alias("check_rc")))
        found = {}
        for some in _batches(outputs):
            found |= self._setup_rows(some)
        for i, entry in enumerate(active):
            row = found.get(i)
            if row is None:
                states.setdefault(entry.table_name, TableState()).failed = True
                self.done.append(_result(self.run, entry, check_rc=RC_BAD_SETUP_OUTPUT))
                continue
            state = states.setdefault(entry.table_name, TableState())
            self._apply_setup(state, entry, row)
            set_up = self._remembered(entry).set_up
            state.since = max((t for t in (state.since, set_up) if t is not None), default=None)
        return states

    def _setup_rows(self, outputs: list[DataFrame]) -> dict[int, Row]:
        """Parsed outputs by position; a setup that breaks while running has none."""
        try:
            parsed = parse_setup_outputs(reduce(DataFrame.unionByName, outputs))
            return {row.i: row for row in parsed.collect()}
        except Exception as e:
            if _is_outage(e):
                raise
            if len(outputs) == 1:
                log.warning("a setup failed: %s", e)
                return {}
            half = len(outputs) // 2
            return self._setup_rows(outputs[:half]) | self._setup_rows(outputs[half:])

    def _apply_setup(self, state: TableState, entry: Row, row: Row) -> None:
        def text(ts: dt.datetime | None) -> str:
            return "" if ts is None else ts.strftime(ISO_BASIC)

        bounds = {"data_start_ts": text(row.data_start_ts), "data_stop_ts": text(row.data_stop_ts)}
        custom = {k: _clean(v) for k, v in row.custom_vars.items()}
        if row.valid:
            state.mode = row.mode
            state.start, state.stop = row.data_start_ts, row.data_stop_ts
            state.vars |= custom | {f"{TABLE_PREFIX}_mode": row.mode}
            state.vars |= {f"{TABLE_PREFIX}_{k}": v for k, v in bounds.items()}
            if row.table_status == "inactive":
                state.status = "inactive"
        else:
            state.failed = True
        self.done.append(
            _result(
                self.run,
                entry,
                check_mode=row.mode,
                check_rc=row.check_rc,
                data_start_timestamp=row.data_start_ts,
                data_stop_timestamp=row.data_stop_ts,
                env_vars=custom | bounds,
            )
        )

    # -- regular checks --------------------------------------------------------

    def _plan(self, entry: Row, state: TableState) -> Planned:
        own = _custom_vars(entry)
        table_vars = {TABLE_PREFIX: entry.table_name} | state.vars | self.user_vars
        known = self.run.vars() | own | table_vars
        check = self.catalogue.checks[entry.check_name]
        incremental = entry.check_mode == state.mode == "incremental"
        if entry.check_mode == "incremental" and state.failed:
            raise ValueError("the setup that opens the window has failed")
        window = self._window(entry, state, own, table_vars) if incremental else None
        df = self._seen(entry.table_name, window)
        body = check.body(self._context(entry.table_name, df, known, window, self._check_memory(entry)))
        later = None
        if check.kind in ("row", "table") and isinstance(body, DataFrame):
            df, body = self._one_row(body), None
        elif check.kind == "table" and callable(body) and not isinstance(body, Column):
            later, body = body, None
        elif check.kind == "partition" and isinstance(body, DataFrame):
            kept = F.col("partition_value").cast("string"), F.col("violations").cast("bigint")
            by_value = body.select(kept[0].alias("partition_value"), kept[1].alias("violations"))
            later, body = partial(self._by_partition, entry, by_value, own.get(f"{CHECK_CUSTOM_PREFIX}partition", "")), None
        elif check.kind == "row":
            body = body.cast("boolean")
        elif check.kind == "aggregate":
            body = body.cast("bigint")
        else:
            raise TypeError(f"{entry.check_name} is a {check.kind} check and returned {type(body)}")
        return Planned(
            entry=entry,
            check=check,
            df=df,
            body=body,
            mode="incremental" if incremental else "full",
            saved_vars=own | table_vars,
            window=(window.start, window.stop) if window else (None, None),
            scan=(entry.table_name, window, check.skips),
            later=later,
        )

    def _window(self, entry: Row, state: TableState, own: dict, table_vars: dict) -> DataWindow:
        """The table's window; for a check that missed earlier ones it begins where its last count ended.

        A check that was tried before and never counted begins with the first row. One that was counted in a run
        which ended before its setups were stored goes on from there. Days before the start that got rows since the
        check was last counted are opened again.
        """

        def given(name: str) -> str | None:
            return own.get(CHECK_CUSTOM_PREFIX + name) or table_vars.get(TABLE_CUSTOM_PREFIX + name)

        column = given("window_col")
        if not column:
            raise KeyError("an incremental check needs a window column")
        start, memory = state.start, self._remembered(entry)
        if memory.last_run is not None and (state.since is None or memory.last_run > state.since):
            start = memory.last_stop
        elif start is not None and memory.tried:
            start = min(start, memory.last_stop) if memory.last_stop else None
        days: tuple[dt.date, ...] = ()
        if start is not None:
            at = memory.last_run or dt.datetime.min
            days = tuple(day for day, found in state.late if found > at and day <= start.date())
        return DataWindow(column, start, state.stop, given("window_form") or "yyyyDDD", days)

    def _seen(self, table: str, window: DataWindow | None) -> DataFrame:
        """The part of a table in the window, the same DataFrame for the same part."""
        key = (table, window)
        if key not in self._frames:
            df = self.tables[table]
            self._frames[key] = df if window is None else window.of(df)
        return self._frames[key]

    def _analyse(self) -> None:
        """Have Spark resolve all predicates of a scan; those that do not are failed."""
        lost = []
        for group in self._scans(self.planned):
            try:
                self._resolve(group)
            except Exception:
                for p in group:
                    try:
                        self._resolve([p])
                    except Exception as e:
                        lost.append((p, e))
        self.done += [_failed(self.run, p.entry, e) for p, e in lost]
        broken = [p for p, _ in lost]
        self.planned = [p for p in self.planned if p not in broken]

    @staticmethod
    def _resolve(group: list[Planned]) -> None:
        df = group[0].df
        df.select(*[p.body for p in group if p.check.kind == "row"])
        df.agg(F.lit(1), *[p.body for p in group if p.check.kind == "aggregate"])

    @staticmethod
    def _scans(planned: Iterable[Planned]) -> list[list[Planned]]:
        scans: dict[tuple, list[Planned]] = {}
        for p in planned:
            if p.body is not None:
                scans.setdefault(p.scan, []).append(p)
        return list(scans.values())

    @staticmethod
    def _one_row(out: DataFrame) -> DataFrame:
        """Check output as ``n, violations, rc, mode, vars``, whatever rows the check gave."""
        column = dict(zip((c.lower() for c in out.columns), out.columns))
        if "violations" not in column:
            raise ValueError("a check has to return violations")
        rc = F.max(F.col(column["rc"]).try_cast("int")) if "rc" in column else F.lit(0)
        mode = F.max(F.col(column["mode"]).cast("string")) if "mode" in column else F.lit(None)
        extra = F.first(F.col(column["vars"])) if "vars" in column else F.lit(None)
        return out.agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.col(column["violations"]).try_cast("bigint")).alias("violations"),
            rc.cast("int").alias("rc"),
            mode.cast("string").alias("mode"),
            extra.cast("map<string,string>").alias("vars"),
        )

    def _properties(self, planned: list[Planned]) -> DataFrame:
        """What is known of results before their checks run, a row per check."""
        rows = [
            (
                str(i),
                p.entry.table_name,
                p.entry.check_alias,
                p.entry.check_type,
                p.check.policy,
                p.check.unit,
                p.entry.check_status,
                p.mode,
                *p.window,
                p.saved_vars,
            )
            for i, p in enumerate(planned)
        ]
        return self.spark.createDataFrame(rows, CHECK_PROPERTIES)

    def counts(self, planned: list[Planned]) -> DataFrame:
        """``key`` (the check's position), ``n``, ``violations``, ``rc``, ``mode``, ``vars``."""
        keys = {id(p): str(i) for i, p in enumerate(planned)}
        parts = [
            self._ready(p).select(F.lit(keys[id(p)]).alias("key"), "n", "violations", "rc", "mode", "vars")
            for p in planned
            if p.body is None
        ]
        for group in self._scans(planned):
            window = group[0].scan[1]
            by_day = self.path is not None and window is not None
            bodies = {
                kind: {keys[id(p)]: p.body for p in group if p.check.kind == kind}
                for kind in ("row", "aggregate")
            }
            counted = []
            if by_day and bodies["row"]:
                counted.append(self._by_day(group, bodies.pop("row"), keys, window))
            if any(bodies.values()):
                counted.append(count_violations(group[0].df, bodies.get("row", {}), bodies["aggregate"]))
            parts += [
                rows.select(
                    F.col("check_alias").alias("key"),
                    F.lit(1).cast("bigint").alias("n"),
                    "violations",
                    F.lit(0).alias("rc"),
                    F.lit(None).cast("string").alias("mode"),
                    F.lit(None).cast("map<string,string>").alias("vars"),
                )
                for rows in counted
            ]
        return reduce(DataFrame.unionByName, parts)

    def _ready(self, planned: Planned) -> DataFrame:
        """A check's one row; what a check left for later is done now."""
        return planned.df if planned.later is None else self._one_row(planned.later())

    def _partition_rows(self, rows: DataFrame, name: str) -> DataFrame:
        run = self.run
        return rows.select(
            F.lit(run.instance).alias("instance_name"),
            F.lit(run.database).alias("database_name"),
            "table_name",
            "check_name",
            F.lit(run.run_id).cast("bigint").alias("run_id"),
            moment(run.started).alias("run_start_timestamp"),
            F.lit(name).alias("partition_name"),
            "partition_value",
            "partition_rows",
            "violations",
            "found",
        )

    def _by_partition(self, entry: Row, counts: DataFrame, name: str) -> DataFrame:
        """Keep the counts by partition, and give their sum; the worst partitions go to the variables.

        The tasks that count write the rows; the driver sees as many as the variables hold.
        """
        if self.path is not None:
            values = {"table_name": F.lit(entry.table_name), "check_name": F.lit(entry.check_alias)}
            values |= {"partition_rows": F.lit(None).cast("bigint"), "found": F.col("violations")}
            counts = PartitionResults(self.spark, self.path).keep(
                self._partition_rows(counts.withColumns(values), name), self.run.started
            )
        known = counts.where(F.col("partition_value").isNotNull() & (F.col("violations") > 0))
        worst = known.orderBy(F.desc("violations"), "partition_value").limit(WORST_PARTITIONS)
        entry_of = F.struct(
            F.concat(F.lit(PARTITION_VAR), "partition_value").alias("key"), F.col("violations").cast("string").alias("value")
        )
        zero = F.lit(0).cast("bigint")
        sums = counts.agg(
            F.coalesce(F.sum("violations"), zero).alias("violations"),
            F.count_if(F.col("partition_value").isNotNull() & (F.col("violations") > 0)).alias("_many"),
            F.lit(None).cast("array<struct<key:string,value:string>>").alias("_worst"),
        )
        named = worst.agg(
            zero.alias("violations"), zero.alias("_many"), F.sort_array(F.collect_list(entry_of)).alias("_worst")
        )
        both = sums.unionByName(named).agg(
            F.sum("violations").alias("violations"), F.sum("_many").alias("_many"), F.max("_worst").alias("_worst")
        )
        many = F.map_from_arrays(F.array(F.lit(PARTITIONS_VAR)), F.array(F.col("_many").cast("string")))
        more = F.when(F.col("_many") > WORST_PARTITIONS, many).otherwise(F.expr("cast(map() as map<string,string>)"))
        return both.select("violations", F.map_concat(F.map_from_entries("_worst"), more).alias("vars"))

    def _by_day(self, group: list[Planned], bodies: dict, keys: dict, window: DataWindow) -> DataFrame:
        """Row checks of a window counted by day, and kept so.

        A day that is opened again counts with what it has beyond the violations that earlier runs found in it.
        """
        df = group[0].df
        counts = count_by_day(df, day_column(df, window.column, window.form), bodies)
        names = self.spark.createDataFrame(
            [(keys[id(p)], p.entry.table_name, p.entry.check_alias) for p in group if keys[id(p)] in bodies],
            "check_alias string, table_name string, check_name string",
        )
        rows = counts.join(F.broadcast(names), "check_alias").withColumnRenamed("violations", "found")
        kept = PartitionResults(self.spark, self.path)
        new = F.col("found")
        if window.days and self.history is not None:
            table = group[0].entry.table_name
            days = [d.isoformat() for d in window.days]
            earlier = kept.committed(
                self.history,
                F.col("instance_name") == self.run.instance,
                F.col("database_name") == self.run.database,
                F.col("table_name") == table,
                F.col("run_id") != self.run.run_id,
            ).where((F.col("partition_name") == window.column) & F.col("partition_value").isin(days))
            before = totals(earlier).withColumnRenamed("violations", "_before")
            rows = rows.join(before, ["table_name", "check_name", "partition_value"], "left")
            new = F.greatest(F.col("found") - F.coalesce("_before", F.lit(0)), F.lit(0))
        written = kept.keep(self._partition_rows(rows.withColumn("violations", new), window.column), self.run.started)
        sums = written.groupBy("table_name", "check_name").agg(F.sum("violations").alias("violations"))
        # a check without any row in the window has no row by day
        every = F.broadcast(names).join(sums, ["table_name", "check_name"], "left")
        return every.select("check_alias", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"))

    def executed(self, planned: list[Planned]) -> DataFrame:
        """Result rows of the given checks."""
        valid = (F.col("n") == 1) & F.col("violations").isNotNull() & F.col("rc").isNotNull()
        mode = F.coalesce("mode", "planned_mode")
        windowed = valid & (mode == "incremental")
        run = self.run
        return self.counts(planned).join(self._properties(planned), "key").select(
            F.lit(run.instance).alias("instance_name"),
            F.lit(run.database).alias("database_name"),
            "table_name",
            "check_name",
            "check_type",
            "check_policy_type",
            F.when(valid, mode).otherwise(F.lit("")).alias("check_mode"),
            "check_unit",
            "check_status",
            F.lit(run.run_id).cast("bigint").alias("run_id"),
            moment(run.started).alias("run_start_timestamp"),
            F.convert_timezone(None, F.lit("UTC"), F.localtimestamp()).alias("run_stop_timestamp"),
            F.when(windowed, F.col("window_start")).alias("data_start_timestamp"),
            F.when(windowed, F.col("window_stop")).alias("data_stop_timestamp"),
            F.when(valid, F.col("rc")).otherwise(F.lit(RC_BAD_CHECK_OUTPUT)).alias("check_rc"),
            F.lit(float(NO_COUNT)).alias("check_scope"),
            F.lit(NO_COUNT).alias("check_severity_score"),
            F.when(valid, F.col("violations"))
            .otherwise(F.lit(NO_COUNT).cast("bigint"))
            .alias("check_violation_cnt"),
            merge_vars(F.col("env_vars"), F.col("vars")).alias("env_vars"),
        )

    def known(self, rows: list[Row]) -> DataFrame:
        names = RESULT_SCHEMA.fieldNames()
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RESULT_SCHEMA)

    def results(self) -> DataFrame:
        """All rows as one plan, not executed: a check that breaks while running breaks it."""
        rows = self.known(self.done)
        return rows.unionByName(self.executed(self.planned)) if self.planned else rows

    # -- executing ---------------------------------------------------------------

    def settled(self) -> DataFrame:
        """The rows of the run, executed in jobs of bounded size, some of them side by side.

        A row per check comes to the driver. If a job breaks, its checks are halved until the broken
        ones stand alone; those are failed. A failure of the cluster or its storage is raised.
        """
        rows = list(self.done)
        for _, some in self.batches():
            rows += some
        return self.known(rows)

    def batches(self) -> Iterator[tuple[str, list[Row]]]:
        """Name and result rows of each job as it ends.

        Of jobs that fail with the cluster or its storage the first error is raised once the others have ended.
        """
        branches = self._scans(self.planned) + [[p] for p in self.planned if p.body is None]
        size = max(LEAST_BRANCHES, min(BRANCHES, -(-len(branches) // PARALLEL)))
        jobs = [[p for branch in branches[i : i + size] for p in branch] for i in range(0, len(branches), size)]
        if not jobs:
            return
        if len(jobs) == 1:
            yield self._batch_name(jobs[0]), self._rows(jobs[0])
            return
        outage = None
        with ThreadPoolExecutor(PARALLEL) as pool:
            running = {}
            for i, job in enumerate(jobs):
                target = inheritable_thread_target(self.spark)(self._in_pool)
                running[pool.submit(target, f"checks-{i % PARALLEL}", job)] = job
            for one in as_completed(running):
                try:
                    rows = one.result()
                except Exception as e:
                    outage = outage or e
                    continue
                yield self._batch_name(running[one]), rows
        if outage is not None:
            raise outage

    def _in_pool(self, pool: str, planned: list[Planned]) -> list[Row]:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return self._rows(planned)

    def _batch_name(self, planned: list[Planned]) -> str:
        """The same for the same checks of the same run, whoever runs them."""
        run = self.run
        names = sorted([p.entry.table_name, p.entry.check_alias] for p in planned)
        text = json.dumps([run.instance, run.database, run.run_id, run.started.isoformat(), names])
        return f"run-{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def _rows(self, planned: list[Planned]) -> list[Row]:
        try:
            return self.executed(planned).collect()
        except Exception as e:
            if _is_outage(e):
                raise
            if len(planned) == 1:
                return [_failed(self.run, planned[0].entry, e)]
            half = len(planned) // 2
            return self._rows(planned[:half]) + self._rows(planned[half:])

    def store(self, path: str) -> None:
        """Store results as jobs end, each in one step; setups come last, as they close the window.

        A run that is ended before leaves what was finished, and the next one opens the window again.
        """
        started = self.run.started
        for name, rows in self.batches():
            commit_results(self.spark, self.known(rows), path, name, begin=started, month=started.date())
        if self.done:
            commit_results(
                self.spark, self.known(self.done), path, f"{self._batch_name([])}-known", begin=started, month=started.date()
            )
        history = read_results(self.spark, path)
        snapshots = latest.Snapshots(self.spark, path, self.run.instance, self.run.database)
        snapshots.advance(history, STOP_VAR, started)


def run_checks(
    spark: SparkSession,
    registry: DataFrame,
    tables: Mapping[str, DataFrame],
    run: Run,
    history: DataFrame | None = None,
    user_vars: Mapping[str, str] | None = None,
    catalogue: Catalogue = BUILT_IN,
) -> DataFrame:
    """Result rows of all checks of a registry, executed.

    ``history`` supplies what earlier runs left behind, ``user_vars`` override the
    variables set by setup checks. An invalid registry raises; a check that cannot
    be planned (a column is missing, say) or breaks while running is a row with rc 202.
    """
    return RunPlan(spark, registry, tables, run, history, user_vars, catalogue).settled()


def run_and_store(
    spark: SparkSession,
    registry: DataFrame,
    tables: Mapping[str, DataFrame],
    run: Run,
    path: str,
    user_vars: Mapping[str, str] | None = None,
    catalogue: Catalogue = BUILT_IN,
) -> DataFrame:
    """Run against the history stored at ``path``, append to it, return this run's rows."""
    history = read_results(spark, path)
    RunPlan(spark, registry, tables, run, history, user_vars, catalogue, path).store(path)
    month = F.lit(run.started.date().replace(day=1))
    return read_results(spark, path).where(
        (F.col("run_month") == month) & (F.col("run_id") == run.run_id)
    )
