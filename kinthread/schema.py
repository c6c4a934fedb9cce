"""Record schemas: named string and list-of-string features, in order."""

from __future__ import annotations

import dataclasses
import enum

from pyspark.sql import types as T


class ElementType(enum.Enum):
    String = "string"
    MultiStrings = "multi_strings"

    @property
    def spark(self) -> T.DataType:
        return T.StringType() if self is ElementType.String else T.ArrayType(T.StringType())


@dataclasses.dataclass(frozen=True)
class FieldSchema:
    name: str
    dtype: ElementType


@dataclasses.dataclass(frozen=True)
class RecordSchema:
    fields: tuple[FieldSchema, ...]

    def __init__(self, fields):
        object.__setattr__(self, "fields", tuple(fields))
        if not self.fields:
            raise ValueError("a record schema needs a field")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]
