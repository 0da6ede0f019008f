"""Registry framing: a zero byte, the schema id as four big-endian bytes, the datum."""

from __future__ import annotations

import json
import os
from collections import OrderedDict
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DEFAULTS


def frame(schema_id: Column, datum: Column, protobuf: bool = False) -> Column:
    """A framed datum; null stays null. A Protobuf datum is preceded by the index byte of its first message."""
    head = F.concat(F.lit(bytearray(b"\x00")), F.unhex(F.lpad(F.hex(schema_id.cast("bigint")), 8, "0")), F.lit(bytearray(b"\x00" if protobuf else b"")))
    return F.when(datum.isNotNull(), F.concat(head, datum))


class Registry:
    """Schemas by (subject, definition), kept in a JSON file; ids never change. The most recent ids are cached."""

    def __init__(self, path: str, cache: int = DEFAULTS["registry_cache"]):
        self.path, self.size = Path(path), cache
        self.cache: OrderedDict[tuple[str, str], int] = OrderedDict()

    def register(self, subject: str, definition: str) -> int:
        key = (subject, definition)
        if key not in self.cache:
            known = json.loads(self.path.read_text()) if self.path.exists() else []
            found = next((e["id"] for e in known if (e["subject"], e["definition"]) == key), None)
            if found is None:
                found = next((e["id"] for e in known if e["definition"] == definition), max((e["id"] for e in known), default=0) + 1)
                known.append({"id": found, "subject": subject, "definition": definition})
                part = self.path.with_suffix(".part")
                part.write_text(json.dumps(known))
                os.replace(part, self.path)
            self.cache[key] = found
        self.cache.move_to_end(key)
        while len(self.cache) > self.size:
            self.cache.popitem(last=False)
        return self.cache[key]
