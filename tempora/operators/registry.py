"""Per-unit statistics of many analyses in one long table, with lookups and comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.keys import canon_unit, session_prefix
from tempora.operators import stats as S
from tempora.operators.describe import combo_counts, keep_one, set_sizes, significant_fraction
from tempora.session import scratch_path

KEYS = ["session_prefix", "unit"]
VALUES = ["t", "p", "q", "coef", "sig_fdr", "n_trials"]


class UnitStatsRegistry:
    """Named entries of (session_prefix, unit, t, p, q, coef, sig_fdr, n_trials).

    Entries stay lazy DataFrames until `store()`; `long()` is their union. `prefix` turns a session column into
    its prefix. Of rows that repeat a unit the first by `order` stays, or without that column the least p, nulls
    last; `repeats(df, ...)` counts the others. When an entry has more units than fit one task, `width` cuts scans over t-values
    and `p_width` those over p-values.
    """

    def __init__(self, alpha: float = 0.05, prefix: Callable[[Column], Column] = session_prefix, width: float | None = None, p_width: float | None = None):
        self.alpha, self.prefix, self.width, self.p_width = alpha, prefix, width, p_width
        # entries registered together share a table of (entry, keys, values), so that one scan serves them all
        self._tables: list[tuple[DataFrame, frozenset[str]]] = []
        self._entries: dict[str, int] = {}
        self._sources: dict[str, str] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._entries

    def __len__(self) -> int:
        return len(self._entries)

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    @property
    def names(self) -> list[str]:
        return sorted(self._entries)

    def list_by_source(self, source: str) -> list[str]:
        return sorted(n for n, s in self._sources.items() if s == source)

    def get(self, name: str) -> DataFrame:
        return self.long([name]).drop("entry", "source")

    def _store(self, names: Sequence[str], source: str, table: DataFrame, overwrite: bool) -> None:
        for name in names:
            if name in self._entries and not overwrite:
                raise ValueError(f"entry {name!r} exists; pass overwrite=True to replace it")
        self._tables.append((table, frozenset(names)))
        for name in names:
            self._entries[name], self._sources[name] = len(self._tables) - 1, source

    def store(self) -> UnitStatsRegistry:
        """Writes the entries to the shared scratch folder, so that later calls read them instead of computing them again."""
        stored = []
        for k, (table, names) in enumerate(self._tables):
            if any(self._entries[n] == k for n in names):
                path = scratch_path(table.sparkSession, "registry")
                table.write.parquet(path)
                table = table.sparkSession.read.schema(table.schema).parquet(path)
            stored.append((table, names))
        self._tables = stored
        return self

    def _normalise(self, df: DataFrame, entry: Column, session: str, unit: str, columns: dict[str, str | None], derive_t: bool) -> DataFrame:
        none = F.lit(None).cast("double")

        def given(k: str) -> Column:
            return F.col(columns[k]).cast("double") if columns.get(k) else none

        n = F.col(columns["n_trials"]).cast("bigint") if columns.get("n_trials") else F.lit(None).cast("bigint")
        t = S.corr_to_t(given("coef"), n, guarded=False) if derive_t else given("t")
        flat = df.select(
            entry.alias("entry"), self.prefix(F.col(session).cast("string")).alias("session_prefix"), canon_unit(F.col(unit).cast("string")).alias("unit"),
            t.alias("t"), given("p").alias("p"), given("q").alias("q"), given("coef").alias("coef"), n.alias("n_trials"),
            (F.col(columns["order"]) if columns.get("order") else F.lit(0)).alias("__at"),
        )
        one = keep_one(flat, ["entry", *KEYS], ["__at", "p", "t", "coef"]).drop("__at")
        if not columns.get("q"):
            one = S.fdr_bh(one.drop("q"), ["entry"], "p", "q", self.p_width)
        return one.withColumn("sig_fdr", F.coalesce(F.col("q") < self.alpha, F.lit(False))).select("entry", *KEYS, *VALUES)

    def repeats(self, df: DataFrame, session: str = "session", unit: str = "unit_id") -> DataFrame:
        """(session_prefix, unit, n) of the units with n > 1 rows, of which registering keeps one."""
        keys = df.select(self.prefix(F.col(session).cast("string")).alias("session_prefix"), canon_unit(F.col(unit).cast("string")).alias("unit"))
        return keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def register_cor(self, name: str, df: DataFrame, *, coef: str, p: str, n_trials: str, t: str | None = None, q: str | None = None, order: str | None = None, session: str = "session", unit: str = "unit_id", source: str = "cor", overwrite: bool = False) -> None:
        """Entry from a correlation table; t and q are derived when not given."""
        if t is None and not (coef and n_trials):
            raise ValueError("either t, or coef and n_trials, must be given")
        columns = {"t": t, "p": p, "q": q, "coef": coef, "n_trials": n_trials, "order": order}
        self._store([name], source, self._normalise(df, F.lit(name), session, unit, columns, t is None), overwrite)

    def register_cor_table(self, names: Sequence[str], df: DataFrame, *, entry: str, coef: str, p: str, n_trials: str, order: str | None = None, session: str = "session", unit: str = "unit_id", source: str = "cor", overwrite: bool = False) -> None:
        """One entry per name out of a table that holds them all, told apart by column `entry`; other names are left out."""
        columns = {"p": p, "coef": coef, "n_trials": n_trials, "order": order}
        rows = df.where(F.col(entry).isin(list(names)))
        self._store(list(names), source, self._normalise(rows, F.col(entry), session, unit, columns, True), overwrite)

    def register_partial(self, name: str, df: DataFrame, **kwargs) -> None:
        self.register_cor(name, df, **{"source": "partial", **kwargs})

    def register_regression(self, name: str, df: DataFrame, *, t: str, p: str, q: str | None = None, coef: str | None = None, n_trials: str | None = None, order: str | None = None, session: str = "session", unit: str = "unit_id", source: str = "regression", overwrite: bool = False) -> None:
        columns = {"t": t, "p": p, "q": q, "coef": coef, "n_trials": n_trials, "order": order}
        self._store([name], source, self._normalise(df, F.lit(name), session, unit, columns, False), overwrite)

    def register_wide(self, prefix: str, df: DataFrame, *, session: str = "session", unit: str = "unit", source: str = "wide", overwrite: bool = False) -> int:
        """One entry `<prefix>::<s>` per `T_<s>` column (with `p_<s>` and `coef_<s>` if there), all in one pass over the table;
        existing entries are skipped unless `overwrite`. Returns the number added."""
        found = [c[2:] for c in df.columns if c.startswith("T_") and (overwrite or f"{prefix}::{c[2:]}" not in self._entries)]
        if not found:
            return 0

        def value(k: str, s: str) -> Column:
            c = f"{k}_{s}"
            return (F.col(c) if c in df.columns else F.lit(None)).cast("double")

        each = F.explode(F.array(*[F.struct(
            F.lit(f"{prefix}::{s}").alias("entry"), value("T", s).alias("t"), value("p", s).alias("p"), value("coef", s).alias("coef")
        ) for s in found])).alias("__each")
        rows = df.select(F.col(session).alias("__session"), F.col(unit).alias("__unit"), each).select("__session", "__unit", "__each.*")
        table = self._normalise(rows, F.col("entry"), "__session", "__unit", {"t": "t", "p": "p", "coef": "coef"}, False)
        self._store([f"{prefix}::{s}" for s in found], source, table, True)
        return len(found)

    def long(self, names: Sequence[str] | None = None) -> DataFrame:
        """(entry, source, keys, values) of the chosen entries."""
        chosen: dict[int, list[str]] = {}
        for name in self.names if names is None else names:
            if name not in self._entries:
                raise KeyError(f"no entry named {name!r}; known entries: {self.names}")
            chosen.setdefault(self._entries[name], []).append(name)
        out = None
        for k, some in chosen.items():
            table, all_names = self._tables[k]
            part = table if all_names == set(some) else table.where(F.col("entry").isin(some))
            part = part.select("entry", F.lit(self._sources[some[0]]).alias("source"), *KEYS, *VALUES)
            out = part if out is None else out.unionByName(part)
        if out is None:
            empty = "entry string, source string, session_prefix string, unit string, t double, p double, q double, coef double, sig_fdr boolean, n_trials bigint"
            out = SparkSession.active().createDataFrame([], empty)
        return out

    def compare(self, a: str, b: str) -> DataFrame:
        return compare_entries(self.get(a), self.get(b))

    def compare_summary(self, a: str, b: str) -> DataFrame:
        return compare_summary(self.compare(a, b), self.width)

    def screen(self, name: str, *, against: Sequence[str] = (), prefix: str | None = None, source: str | None = None, min_n: int = 10, rank_by: str = "abs_rho", top_n: int | None = None) -> DataFrame:
        """Spearman of one entry's t with the t of others; nulls below `min_n` units."""
        targets = set(against)
        if prefix:
            targets |= {n for n in self.names if n.startswith(prefix)}
        if source:
            targets |= set(self.list_by_source(source))
        targets = sorted((targets or set(self.names)) - {name})
        pairs = entry_pairs(self.long([name]), self.long(targets), ordered=False)
        known = SparkSession.active().createDataFrame([(t,) for t in targets], "entry_b string")
        out = S.spearman(pairs, ["entry_b"], "t_a", "t_b", min_n, self.width)
        table = known.join(out, "entry_b", "left").select(
            F.col("entry_b").alias("entry"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "rho", "p", F.abs("rho").alias("abs_rho")
        )
        order = F.asc_nulls_last("p") if rank_by == "p" else F.desc_nulls_last(rank_by)
        table = table.orderBy(order, "entry")
        return table.limit(top_n) if top_n else table

    def matrix(self, names: Sequence[str] | None = None, min_n: int = 3) -> DataFrame:
        """Pairwise Spearman of t, long form, each pair once."""
        long = self.long(names)
        return S.spearman(entry_pairs(long, long), ["entry_a", "entry_b"], "t_a", "t_b", min_n, self.width)

    def membership(self, names: Sequence[str], min_size: int = 1, by: str = "cardinality", max_subsets: int | None = None) -> DataFrame:
        return combo_counts(significance_flags(self.long(names), names), names, min_size, by, max_subsets)

    def set_sizes(self, names: Sequence[str]) -> DataFrame:
        """(entry, n): significant units per entry, among the units that every entry has."""
        return set_sizes(significance_flags(self.long(names), names), names)

    def summary(self) -> DataFrame:
        return entry_summary(self.long(), self.width)

    def top_fractions(self, n: int) -> DataFrame:
        return significant_fraction(self.long(), "entry", "sig_fdr").orderBy(F.desc("frac_sig"), "entry").limit(n)


def entry_pairs(a: DataFrame, b: DataFrame, ordered: bool = True) -> DataFrame:
    """Both t-values per unit and pair of entries, each unordered pair once.

    One equi join on the unit; the number of entries is set by the user, not by the data.
    """
    left = a.select(*KEYS, F.col("entry").alias("entry_a"), F.col("t").alias("t_a"), F.col("sig_fdr").alias("sig_a"))
    right = b.select(*KEYS, F.col("entry").alias("entry_b"), F.col("t").alias("t_b"), F.col("sig_fdr").alias("sig_b"))
    pairs = left.join(right, KEYS)
    return pairs.where(F.col("entry_a") < F.col("entry_b")) if ordered else pairs


def compare_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units of both entries with a category by significance; rows without a t are dropped."""
    left = a.select(*KEYS, F.col("t").alias("t_a"), F.col("sig_fdr").alias("sig_a"))
    right = b.select(*KEYS, F.col("t").alias("t_b"), F.col("sig_fdr").alias("sig_b"))
    category = F.when(F.col("sig_a") & F.col("sig_b"), "both").when(F.col("sig_a"), "a_only").when(
        F.col("sig_b"), "b_only"
    ).otherwise("neither")
    return left.join(right, KEYS).dropna(subset=["t_a", "t_b"]).withColumn("category", category)


def compare_summary(compared: DataFrame, width: float | None = None) -> DataFrame:
    """rho, p and the overlap table of a comparison."""
    rho = S.spearman(compared, [], "t_a", "t_b", 3, width).select(F.struct("n", "rho", "p")).scalar()
    overlap = S.fisher_overlap(compared, [], F.col("sig_a"), F.col("sig_b")).withColumnRenamed("p", "fisher_p")
    return overlap.withColumn("__r", rho).select(
        "__r.n", "__r.rho", F.col("__r.p").alias("rho_p"), "both", "a_only", "b_only", "neither", "odds_ratio", "fisher_p"
    )


def significance_flags(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One boolean column per entry for the units that every entry has."""
    wide = long.groupBy(*KEYS).pivot("entry", list(names)).agg(F.bool_or("sig_fdr"))
    return wide.dropna(subset=list(names))


def entry_summary(long: DataFrame, width: float | None = None) -> DataFrame:
    """n, significant counts by sign, mean and median t, signed-rank and sign tests per entry."""
    from tempora.operators.ordered import quantiles

    base = long.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sig_fdr").alias("n_sig"), F.avg("t").alias("mean_t"),
        F.count_if(F.col("sig_fdr") & (F.col("t") > 0)).alias("n_pos_sig"),
        F.count_if(F.col("sig_fdr") & (F.col("t") < 0)).alias("n_neg_sig"),
    ).withColumn("frac_sig", F.col("n_sig") / F.col("n"))
    median = quantiles(long, ["entry"], "t", {"median_t": 0.5}, width)
    signed = S.wilcoxon(long, ["entry"], "t", 10, width).select("entry", F.col("p").alias("wilcoxon_p"))
    sign = S.sign_binomial(long, ["entry"], "t").select("entry", F.col("p").alias("binomial_p"))
    return base.join(median, "entry", "left").join(signed, "entry", "left").join(sign, "entry", "left")
