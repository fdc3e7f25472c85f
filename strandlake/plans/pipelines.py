"""End-to-end plans: curated interactions, relation augmentation, link-prediction evaluation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import to_number, validate_protein
from ..operators import linkpred, relational, simjoin
from ..operators.align import align_pairs
from ..operators.ranking import RankedLists
from ..store import materialize


def interpolate(tree: dict) -> dict:
    """Nested settings with each ``${a.b}`` replaced by the value at that path; a text that is nothing else takes the value's type."""

    def at(path: str, open_: tuple):
        if path in open_:
            raise ValueError(f"settings refer to each other: {path}")
        value = tree
        for name in path.split("."):
            if not isinstance(value, dict) or name not in value:
                raise ValueError(f"no such setting: {path}")
            value = value[name]
        return fill(value, (*open_, path))

    def fill(value, open_: tuple = ()):
        if isinstance(value, dict):
            return {k: fill(v, open_) for k, v in value.items()}
        if isinstance(value, list):
            return [fill(v, open_) for v in value]
        if not isinstance(value, str):
            return value
        if whole := re.fullmatch(r"\$\{([\w.]+)\}", value):
            return at(whole[1], open_)
        return re.sub(r"\$\{([\w.]+)\}", lambda m: str(at(m[1], open_)), value)

    return fill(tree)


@dataclass(frozen=True)
class Experiment:
    """Settings of an embedding experiment (fixed values: the published defaults)."""

    dimension: int = 400
    epochs: int = 30
    batch_size: int = 1000
    learning_rate: float = 0.01
    margin: float = 0.1
    operator: str = "translation"
    comparator: str = "l2"
    negatives: int = linkpred.NEGATIVES
    cutoffs: tuple[int, ...] = linkpred.CUTOFFS
    train_share: float = 0.8
    seed: int = 42
    relations: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def from_yaml(text: str) -> Experiment:
        """Settings from YAML with ``${path}`` references; those in sections count as if they stood at the top, unknown names are refused."""
        import yaml

        given = {}
        for name, value in interpolate(yaml.safe_load(text) or {}).items():
            given |= value if isinstance(value, dict) else {name: value}
        unknown = set(given) - set(Experiment.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Experiment(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def curate_interactions(raw: DataFrame, name: str, sequence: str, ligand: str, smiles: str, kd: str, ki: str, order: str, smiles_issue: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) protein-ligand interactions.

    Incomplete rows are dropped, quotes removed, the first of each interaction kept, the constant of
    inhibition taken where that of dissociation is missing. ``smiles_issue`` is a chemistry hook's
    verdict, null where the molecule is valid.
    """
    keys = [name, sequence, ligand, smiles]
    texts = [f.name for f in raw.schema if f.dataType.simpleString() == "string"]
    clean = raw.dropna(subset=keys).withColumns({c: F.replace(F.col(c), F.lit('"')) for c in texts})
    first = relational.keep_first(clean, keys, [order])
    checked = first.withColumn("p", validate_protein(F.col(sequence))).withColumns({
        kd: to_number(F.coalesce(F.col(kd).cast("string"), F.col(ki).cast("string"))),
        "protein_sequence": F.col("p.sequence"),
        "protein_issue": F.col("p.issue"),
        "smiles_issue": F.lit(None).cast("string") if smiles_issue is None else smiles_issue,
    }).drop("p")
    checked = materialize(checked, "checked")  # both parts are of one check
    ok = F.col("protein_issue").isNull() & F.col("smiles_issue").isNull()
    return checked.where(ok), checked.where(~ok)


def entity_table(interactions: DataFrame, pairs: list[tuple[str, str, str]], order: str) -> DataFrame:
    """Entities (name, content, type) of the ends of interactions, the first of each content."""
    sides = [F.struct(F.lit(i).alias("side"), F.col(order).alias("at"), F.col(n).alias("name"), F.col(c).alias("content"), F.lit(t).alias("type")) for i, (n, c, t) in enumerate(pairs)]
    rows = interactions.select(F.explode(F.array(*sides)).alias("e")).select("e.*").where(F.col("content").isNotNull())
    return relational.keep_first(rows, ["content"], ["side", "at"]).drop("side", "at")


def similarity_edges(entities: DataFrame, id_col: str, content: str, vector: str, k: int = 200, metric: str = "cos", mode: str = "global") -> DataFrame:
    """Alignment identities of the pairs proposed by nearest vectors, each unordered pair once."""
    near = simjoin.nearest(entities, id_col, vector, k, metric)
    pairs = relational.best_undirected(near.drop("rank"), "src", "dst", "score")
    named = relational.lookup(relational.lookup(pairs, "src", entities, id_col, content, "content_1"), "dst", entities, id_col, content, "content_2")
    return align_pairs(named, "content_1", "content_2", mode=mode).select(F.col("src").alias("id_1"), "content_1", F.col("dst").alias("id_2"), "content_2", "score", "alignment")


def evaluate(test: DataFrame, known: DataFrame, entities: DataFrame, params: Column, settings: Experiment = Experiment()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics of each source, their summary, pooled best-F1 threshold) of test links against filtered negatives."""
    true = linkpred.true_links(test, entities)
    lists = RankedLists(true, known, entities, params, settings.operator, settings.comparator, settings.negatives, settings.seed)
    metrics = linkpred.source_metrics(lists.true_rows(), settings.cutoffs)
    return metrics, linkpred.summary(metrics, settings.cutoffs), lists.best_f1()
