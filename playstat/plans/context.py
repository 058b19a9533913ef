"""What an analysis runs on: the tables (as bundles) and its parameters."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import SparkSession

from playstat.session import cut_lineage, release
from playstat.sources.adapters import events_bundle, lineitem_bundle
from playstat.sources.loader import load_bundle
from playstat.sources.schemas import HOT_KEY_ROWS, Bundle


@dataclass(frozen=True)
class Params:
    """Analysis parameters; the defaults are those of the original analyses."""
    session_gap: int = 30 * 60
    min_session_len: int = 6
    window_size: int = 100
    window_step: int = 50
    history_len: int = 20
    min_history: int = 3
    eligible_min_organic: int = 5
    eligible_min_rec: int = 1
    bootstrap_b: int = 2000
    seed: int = 42
    hot_session_rows: int = HOT_KEY_ROWS


class Context:
    """``volume`` feeds the listen-only analyses (H1, H5, H6 and their tables);
    ``behaviour`` feeds everything that joins listens with likes, dislikes,
    sessions or vectors. For real interaction data both are the same bundle.
    Bundles may be given as zero-argument factories; they are built on first
    use, so a query pays only for the tables it reads."""

    def __init__(self, spark: SparkSession, volume, behaviour, params: Params | None = None):
        self.spark = spark
        self._volume, self._behaviour = volume, behaviour
        self.params = params or Params()
        self._shared: dict | None = None
        self._lock = threading.RLock()

    def sharing(self) -> "Context":
        """A context whose ``shared`` frames are written once and read by all analyses."""
        if self._shared is not None:
            return self
        own = Context(self.spark, self.volume, self.behaviour, self.params)
        own._shared = {}
        return own

    def shared(self, name: str, make, write=cut_lineage):
        """``make()``, or the frame of that name written before by ``write`` (see ``sharing``)."""
        if self._shared is None:
            return make()
        with self._lock:
            if name not in self._shared:
                self._shared[name] = write(make())
            return self._shared[name]

    def release(self) -> None:
        """Deletes the shared tables that lie as files, when every result is written itself."""
        if self._shared:
            release(*[t for t in self._shared.values() if hasattr(t, "written_path")])
            self._shared = {}

    @staticmethod
    def _get(v):
        return v() if callable(v) else v

    @property
    def volume(self) -> Bundle:
        self._volume = self._get(self._volume)
        return self._volume

    @property
    def behaviour(self) -> Bundle:
        self._behaviour = self._get(self._behaviour)
        return self._behaviour

    @staticmethod
    def from_folder(spark: SparkSession, path: str, params: Params | None = None,
                    clock: str = "cumsum", order_cols: tuple[str, ...] = ()) -> "Context":
        b = load_bundle(spark, path, clock, order_cols)
        return Context(spark, b, b, params or Params())

    @staticmethod
    def from_bundle(spark: SparkSession, b: Bundle, params: Params | None = None) -> "Context":
        return Context(spark, b, b, params or Params())


# fixed values: parameters that keep the synthetic events non-degenerate
# (users there have fewer than 100 events and day-long gaps)
TESTDATA_PARAMS = Params(session_gap=86_400, window_size=20, window_step=10)


def testdata_context(spark: SparkSession, sf_dir: str) -> Context:
    """Adapter views over the given tables (see ``sources.adapters``)."""
    return Context(spark, lambda: lineitem_bundle(spark, sf_dir), lambda: events_bundle(spark, sf_dir),
                   TESTDATA_PARAMS)
