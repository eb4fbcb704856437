"""The five domain tables, carried together through every job."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    events: DataFrame      # webhook_events
    endpoints: DataFrame
    attempts: DataFrame    # delivery_attempts (the fact table)
    replays: DataFrame     # replay_actions

    def with_(self, **kw) -> "Tables":
        return replace(self, **kw)

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "users": self.users,
            "webhook_events": self.events,
            "endpoints": self.endpoints,
            "delivery_attempts": self.attempts,
            "replay_actions": self.replays,
        }
