"""Answer providers as injected callables. Nothing here opens a connection: without a transport a provider refuses, so
that an empty result is never mistaken for an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: (action, request text) -> reply body as JSON text; must be importable by the workers.
Transport = Callable[[str, str], str]


class NotConfigured(RuntimeError):
    """A provider was asked without a transport."""


@dataclass(frozen=True)
class Provider:
    """A name, list prices by action and how it is reached."""

    name: str
    prices: tuple[tuple[str, float], ...]
    transport: Transport | None = None

    def price(self, action: str) -> float:
        for a, p in self.prices:
            if a == action:
                return p
        raise ValueError(f"{self.name} has no action {action}")


def ask(requests: DataFrame, provider: Provider, action: str, request: str = "request") -> DataFrame:
    """requests with body, the provider's reply, and list_price. One call per row, in the workers; rows whose request is
    NULL are not asked and have a NULL body. Ask distinct requests that the cache does not have, and join back."""
    if provider.transport is None:
        raise NotConfigured(provider.name)
    price = provider.price(action)
    names = [c for c in requests.columns if c not in ("body", "list_price")]
    rows = requests.select(*names)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(body=[provider.transport(action, r) if r is not None else None for r in b[request]], list_price=price)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "body string, list_price double"])
    return rows.mapInPandas(run, schema)
