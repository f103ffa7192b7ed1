"""Rule tables: concepts with aliases, and graph transformations.

Both are inputs. A concept table has ``(ordinal, concept, slug, reward, penalty, rarity, aliases)``,
a transformation table ``(ordinal, slug, method, equipment, tags, output_slug, output_name, inputs)``
where ``inputs`` is an array of ``(ingredient, component, optional, role)``. They are configuration:
whatever their size they become part of the plan. Alias tables that are data rather than
configuration are matched by ``alias_match_joined``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from larder.functions.js import table_literal

CONCEPT_SCHEMA = (
    "ordinal int, concept string, slug string, reward double, penalty double, rarity string, "
    "aliases array<string>"
)
TRANSFORM_SCHEMA = (
    "ordinal int, slug string, name string, method string, time_minutes int, difficulty string, "
    "equipment array<string>, tags array<string>, output_slug string, output_name string, "
    "inputs array<struct<ingredient:string,component:string,optional:boolean,role:string>>"
)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONCEPT_SCHEMA).json(path, multiLine=True)


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSFORM_SCHEMA).json(path, multiLine=True)


@dataclass(frozen=True)
class Concept:
    concept: str
    slug: str | None
    reward: float
    penalty: float
    rarity: str
    aliases: tuple[str, ...]

    @property
    def total_penalty(self) -> float:
        return self.penalty + {"specialist": 2.0, "luxury": 4.0}.get(self.rarity, 0.0)


@dataclass(frozen=True)
class Input:
    ingredient: str | None = None
    component: str | None = None
    optional: bool = False
    role: str | None = None


@dataclass(frozen=True)
class Transform:
    slug: str
    output_slug: str
    inputs: tuple[Input, ...]
    method: str = ""
    tags: tuple[str, ...] = ()
    equipment: tuple[str, ...] = ()
    output_name: str = ""
    name: str = ""
    time_minutes: int = 0
    difficulty: str = "easy"

    @property
    def required(self) -> tuple[Input, ...]:
        return tuple(i for i in self.inputs if not i.optional)


def concepts_from(df: DataFrame) -> tuple[Concept, ...]:
    return tuple(
        Concept(r.concept, r.slug, r.reward, r.penalty, r.rarity, tuple(r.aliases))
        for r in df.orderBy("ordinal").toLocalIterator()
    )


def transforms_from(df: DataFrame) -> tuple[Transform, ...]:
    return tuple(
        Transform(
            slug=r.slug, output_slug=r.output_slug, method=r.method or "", tags=tuple(r.tags or ()),
            equipment=tuple(r.equipment or ()), output_name=r.output_name or "", name=r.name or "",
            time_minutes=r.time_minutes or 0, difficulty=r.difficulty or "easy",
            inputs=tuple(Input(i.ingredient, i.component, bool(i.optional), i.role) for i in r.inputs),
        )
        for r in df.orderBy("ordinal").toLocalIterator()
    )


def concepts_df(spark: SparkSession, concepts: tuple[Concept, ...]) -> DataFrame:
    rows = [
        (n, c.concept, c.slug, c.reward, c.penalty, c.rarity, list(c.aliases))
        for n, c in enumerate(concepts)
    ]
    return spark.createDataFrame(rows, CONCEPT_SCHEMA)


def transforms_df(spark: SparkSession, transforms: tuple[Transform, ...]) -> DataFrame:
    rows = [
        (
            n, t.slug, t.name, t.method, t.time_minutes, t.difficulty, list(t.equipment), list(t.tags),
            t.output_slug, t.output_name,
            [(i.ingredient, i.component, i.optional, i.role) for i in t.inputs],
        )
        for n, t in enumerate(transforms)
    ]
    return spark.createDataFrame(rows, TRANSFORM_SCHEMA)


def aliases(concepts: tuple[Concept, ...]) -> list[tuple[str, Concept]]:
    """Aliases in match order: longest first, then table order, the concept's own name last."""
    entries = [(a.lower(), c) for c in concepts for a in (*c.aliases, c.concept)]
    return sorted(entries, key=lambda e: -len(e[0]))


def alias_literal(concepts: tuple[Concept, ...]) -> Column:
    rows = [{"alias": a, "concept": c.concept, "slug": c.slug} for a, c in aliases(concepts)]
    return table_literal(rows, "alias:string,concept:string,slug:string")


def meta_literal(concepts: tuple[Concept, ...]) -> Column:
    rows = [
        {"concept": c.concept, "slug": c.slug, "reward": float(c.reward), "penalty": float(c.total_penalty)} for c in concepts
    ]
    return table_literal(rows, "concept:string,slug:string,reward:double,penalty:double")
