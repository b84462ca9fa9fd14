"""Lattices as snapshots, and routing among those of several partitions."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from operator import mul
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternary_rules.functions.sentinels import SPARK_TYPE, literal, not_set_sentinel_for, unknown_sentinel_for
from ternary_rules.plans.model import Aggregate, DataType, Dimension, DimensionsMetadata, MatchStrategy, dump_yaml, load_yaml
from ternary_rules.sources.contexts import as_mapping, extract_context_values, prepare_contexts
from ternary_rules.sources.storage import read_text, stored, write_text

from .accumulator import AccumulatorEngine, AccumulatorResult
from .filter_engine import ExpressionRulesEngine
from .results import BatchRuleResult


class AmbiguousPartitionError(KeyError):
    """Two partitions fit a context equally well."""


class Lattice:
    def __init__(self, dataframe: DataFrame, metadata: DimensionsMetadata, aggregates: list[Aggregate], partition_key: dict[str, Any] | None = None):
        self.combinations, self.metadata, self.aggregates, self.partition_key = dataframe, metadata, list(aggregates), partition_key

    @property
    def count(self) -> int:
        return self.combinations.count()

    @property
    def is_composed(self) -> bool:
        return "__prime_product" in self.combinations.columns

    def save(self, dir_path: str | Path) -> Path:
        """lattice.parquet and manifest.yaml in a folder of any store that Spark reaches."""
        spark, base = self.combinations.sparkSession, str(dir_path)
        self.combinations.write.mode("overwrite").parquet(f"{base}/lattice.parquet")
        key = None if self.partition_key is None else {k: v.isoformat() if isinstance(v, (date, datetime)) else v for k, v in self.partition_key.items()}
        manifest = {"metadata": self.metadata.to_dict(), "aggregates": [{"column_name": a.column_name, "operation": a.operation.value} for a in self.aggregates], "partition_key": key}
        write_text(spark, f"{base}/manifest.yaml", dump_yaml(manifest))
        return Path(dir_path)

    @classmethod
    def load(cls, dir_path: str | Path, spark: SparkSession | None = None) -> Lattice:
        spark, base = spark or SparkSession.active(), str(dir_path)
        manifest = load_yaml(read_text(spark, f"{base}/manifest.yaml"))
        metadata = DimensionsMetadata.from_dict(manifest["metadata"])
        key = manifest["partition_key"]
        if key is not None:
            kinds = {d.dimension_name: d.data_type for d in metadata.dimensions}
            parse = {DataType.DATE: date.fromisoformat, DataType.DATETIME: datetime.fromisoformat}
            key = {k: parse[kinds[k]](v) if isinstance(v, str) and kinds.get(k) in parse else v for k, v in key.items()}
        return cls(spark.read.parquet(f"{base}/lattice.parquet"), metadata, [Aggregate(**a) for a in manifest["aggregates"]], key)


class LatticeIndex:
    """Finds the lattice whose partition key fits a context best: the exact key, else the most
    specific one among those with wildcards."""

    def __init__(self, engine: AccumulatorEngine, lattices: list[Lattice], validate: bool = True, max_witnesses: int = 1_000_000):
        self.engine, self.lattices, self.keys = engine, list(lattices), engine.keys
        self._check_structure()
        self._exact = {} if not self.keys else {self._tuple(x.partition_key): n for n, x in enumerate(self.lattices)}
        self._meta, self._all = None, None
        if self.keys:
            dims = [Dimension(dimension_name=d.dimension_name, context_field=d.resolved_context_field, rule_field=f"k{n}", match_strategy=MatchStrategy.EXACT_KEY, data_type=d.data_type) for n, d in enumerate(self.keys)]
            spark = self.lattices[0].combinations.sparkSession
            rows = [(n, *self._tuple(x.partition_key)) for n, x in enumerate(self.lattices)]
            schema = ", ".join(["lattice int", *[f"k{n} {SPARK_TYPE[d.data_type]}" for n, d in enumerate(self.keys)]])
            self._meta = ExpressionRulesEngine(stored(spark.createDataFrame(rows, schema)), DimensionsMetadata(dims), rule_order_field="lattice")
            if validate:
                self._check_witnesses(max_witnesses)

    def _tuple(self, key: dict[str, Any]) -> tuple:
        return tuple(key[d.dimension_name] for d in self.keys)

    def _check_structure(self) -> None:
        if not self.lattices:
            raise ValueError("an index needs a lattice")
        if not self.keys:
            if len(self.lattices) > 1:
                raise ValueError("several lattices need context keys to choose by")
            return
        seen = set()
        for x in self.lattices:
            if not x.partition_key:
                raise ValueError("a lattice without a partition key cannot be routed to")
            if set(x.partition_key) != {d.dimension_name for d in self.keys}:
                raise ValueError(f"the key {x.partition_key} does not name the context keys")
            for d in self.keys:
                value = x.partition_key[d.dimension_name]
                if d.data_type is not DataType.BOOL and value == not_set_sentinel_for(d.data_type):
                    raise ValueError(f"the key {x.partition_key} holds the mark of a missing value")
            if self._tuple(x.partition_key) in seen:
                raise ValueError(f"the key {x.partition_key} is there twice")
            seen.add(self._tuple(x.partition_key))

    def _check_witnesses(self, most: int) -> None:
        """Every combination of a key's values and one other value per dimension has one best partition."""
        classes = []
        for d in self.keys:
            wild = {unknown_sentinel_for(d.data_type), None}
            values = {x.partition_key[d.dimension_name] for x in self.lattices} - wild
            classes.append([*sorted(values), not_set_sentinel_for(d.data_type)])
        n = reduce(mul, map(len, classes))
        if n > most:
            raise ValueError(f"{n} witnesses are over max_witnesses, {most}")
        spark = self.lattices[0].combinations.sparkSession
        frame = spark.range(1).select()
        for d, values in zip(self.keys, classes, strict=True):  # n rows, checked above
            frame = frame.withColumn(d.resolved_context_field, F.explode(F.array(*[literal(v, d.data_type) for v in values])))
        ties = self._ties(self._route(stored(frame)))
        if ties:
            raise AmbiguousPartitionError(f"partitions {ties} fit one context equally well")

    def _route(self, contexts: DataFrame, context_id_field: str | None = None) -> BatchRuleResult:
        return self._meta.evaluate_batch(contexts, context_id_field=context_id_field, include_observability=False, check_ids=False)

    def _ties(self, routed: BatchRuleResult) -> list | None:
        # both groupings keep the partitions that the contexts were dealt to
        equal = routed.survivors.groupBy("__context_id", "__specificity").agg(F.count(F.lit(1)).alias("n"), F.min("lattice").alias("a"), F.max("lattice").alias("b"))
        top = equal.groupBy("__context_id").agg(F.max(F.struct("__specificity", "n", "a", "b")).alias("top"))
        found = top.where("top.n > 1").select("top.*").first()
        return None if found is None else [self.lattices[found["a"]].partition_key, self.lattices[found["b"]].partition_key]

    def route(self, context: Any) -> Lattice:
        if not self.keys:
            return self.lattices[0]
        values = extract_context_values(as_mapping(context), self.keys)
        exact = self._exact.get(tuple(values[d.dimension_name] for d in self.keys))
        if exact is not None:
            return self.lattices[exact]
        rows = self._meta.evaluate(context).survivors.orderBy("__rank").limit(2).collect()
        if not rows:
            raise KeyError(f"no partition fits {values}")
        if len(rows) > 1 and rows[0]["__specificity"] == rows[1]["__specificity"]:
            raise AmbiguousPartitionError(f"{values} fits {[self.lattices[r['lattice']].partition_key for r in rows]} equally well")
        return self.lattices[rows[0]["lattice"]]

    def apply(self, context: Any, dimensions: list[str] | None = None) -> AccumulatorResult:
        return self.engine.apply(self.route(context), context, dimensions)

    def apply_batch(self, contexts: DataFrame, context_id_field: str | None = None, dimensions: list[str] | None = None) -> BatchRuleResult:
        """All contexts at once: each is routed, then meets the combinations of its lattice in an
        equality join. Contexts that fit no partition have no survivors."""
        frames = [x.combinations.withColumn("__lattice", F.lit(n)) for n, x in enumerate(self.lattices)]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if self._all is None:
            self._all = ExpressionRulesEngine(stored(union), self.engine.apply_metadata())
        active = self._all._active(dimensions)
        if context_id_field is None:
            from ternary_rules.sources.contexts import with_index

            contexts = stored(with_index(contexts, "__cid"))
            context_id_field = "__cid"
        prepared = prepare_contexts(contexts, self._all._dimensions(active), context_id_field)
        if self.keys:
            routed = self._route(contexts, context_id_field)
            tie = self._ties(routed)
            if tie:
                raise AmbiguousPartitionError(f"a context fits {tie} equally well")
            choice = routed.best_matches.select("__context_id", F.col("lattice").alias("__lattice"))
            prepared = prepared.join(choice, "__context_id")
        else:
            prepared = prepared.withColumn("__lattice", F.lit(0))
        return self._all.rank_pairs(self._all.pairs(prepared, active, on=["__lattice"]).drop("__lattice"), active, context_id_field)
