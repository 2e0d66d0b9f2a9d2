"""Train on one set, evaluate or apply on another: ROC, counts, score map, scored copy, masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from labelquarry.operators import report, runs, spatial
from labelquarry.operators.features import renormalize
from labelquarry.operators.scoring import Model, Scorer, classify
from labelquarry.operators.spatial import attach_boundaries
from labelquarry.functions.text import polygon_points
from pyspark.sql import functions as F


@dataclass
class Validation:
    """A fitted model and the objects it is used on; every method is a lazy table."""

    model: Model
    objects: DataFrame

    @classmethod
    def train(cls, training: DataFrame, objects: DataFrame, scorer: Scorer,
              own_params: DataFrame | None = None, target_params: DataFrame | None = None) -> "Validation":
        """The training set is expressed in the target's normalisation when both parameter
        tables are given."""
        if own_params is not None and target_params is not None:
            training = renormalize(training, own_params, target_params)
        return cls(scorer.fit(training), objects)

    def scores(self) -> DataFrame:
        return self.model.score(self.objects)

    def roc(self) -> tuple[DataFrame, DataFrame]:
        scored = self.scores()
        return report.roc_points(scored), report.confusion_matrix(scored)

    def counts(self) -> DataFrame:
        return report.count_report(classify(self.scores()))

    def score_map(self, slide: str) -> DataFrame:
        return report.slide_score_map(self.scores(), slide)

    def mask_runs(self, rois: DataFrame, slides: DataFrame, boundaries: DataFrame, background: float | None = runs.BACKGROUND) -> DataFrame:
        """The scored polygons of each region as runs of pixels in region coordinates, over a background.

        Objects take part whose centre lies in the padded region; what sticks out is clipped before it is drawn.
        """
        known = spatial.known_regions(rois, self.objects)
        boxes = spatial.padded_region(known, slides)
        region = ["slide", "start_x", "start_y", "width", "height"]
        inside = spatial.roi_objects(boxes, self.scores()).select(*region, "object_id", "x", "y", "score")
        drawn = attach_boundaries(inside, boundaries).where("boundary IS NOT NULL").withColumn(
            "points", polygon_points(F.col("boundary"))
        )
        return runs.region_masks(drawn, known, region, background=background)

    def mask(self, rois: DataFrame, slides: DataFrame, boundaries: DataFrame, background: float | None = None) -> DataFrame:
        """Pixels of :meth:`mask_runs`, by default without those of the background."""
        return runs.run_pixels(self.mask_runs(rois, slides, boundaries, background)).drop("object_id")

    def object_labels(self, tile: int = spatial.TILE_SIZE, boundaries: DataFrame | None = None) -> DataFrame:
        """Running object numbers over the tiles of each slide, with scores; with ``boundaries``, of the objects that have
        one, for each closed tile that they lie in."""
        if boundaries is not None:
            return spatial.drawn_object_labels(self.scores(), boundaries, tile)
        return spatial.object_labels_by_tile(self.scores(), tile)
