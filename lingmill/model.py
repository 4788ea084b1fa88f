"""Table kinds: a DataFrame with its roles, and the names of stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from lingmill.functions.transforms import transform_tag

FEATURE_COLUMNS = ["group_id", "feat", "value", "group_norm"]


@dataclass(frozen=True)
class Messages:
    df: DataFrame
    message_id: str = "message_id"
    message: str = "message"
    group: str = "user_id"
    date: str | None = None


@dataclass(frozen=True)
class FeatureTable:
    """group_id, feat, value, group_norm, with where they come from."""

    df: DataFrame
    feature: str
    source: str
    group: str
    transform: str = "identity"
    extensions: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        parts = ["feat", self.feature, self.source, self.group]
        if self.transform != "identity":
            parts.append(transform_tag(self.transform))
        return "$".join([*parts, *self.extensions])

    def with_df(self, df: DataFrame, *extensions: str, feature: str | None = None) -> FeatureTable:
        return replace(self, df=df, extensions=(*self.extensions, *extensions), feature=feature or self.feature)


def parsed_name(name: str) -> dict[str, str | list[str]]:
    """The parts of a table name."""
    kind, feature, source, group, *rest = name.split("$")
    if kind != "feat":
        raise ValueError(f"{name} doesn't name a feature table")
    tag = next((r for r in rest if r.startswith("16to")), "16to16")
    return {"feature": feature, "source": source, "group": group, "transform": tag, "extensions": [r for r in rest if not r.startswith("16to")]}


def default_frequency_threshold(group: str) -> int:
    """Words a group needs by default: few for messages, more for users and regions."""
    name = group.lower()
    if "mess" in name or name.endswith("_mid") or name in ("doc_id", "id"):
        return 1
    if "user" in name or name.startswith("usr") or "author" in name:
        return 500
    if "county" in name or "cnty" in name or "state" in name or "region" in name:
        return 40_000
    return 1000
