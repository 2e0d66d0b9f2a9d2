"""Catalog tables: slides, datasets, their links, training and test sets.

Joins carry no broadcast hints: small sides are broadcast by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks in feature file names and the crop sizes (offset, size) of thumbnails by
# superpixel size, None standing for any other size.
REGION_MARK = "spfeatures"
PATCH_MARK = "pofeatures"
NUCLEUS_CROP = (25, 50.0)
REGION_CROPS = {8: (18, 32.0), 16: (36, 64.0), None: (64, 128.0)}
DEFAULT_CLASS_NAMES = ("Negative", "Positive")
DEFAULT_PATCH_SIZE = 28


def datasets_by_kind(datasets: DataFrame) -> DataFrame:
    """Column ``kind``: region, patch or nuclei, from the feature file name."""
    name = F.col("features_file")
    kind = F.when(name.like(f"%{REGION_MARK}%"), "region").when(name.like(f"%{PATCH_MARK}%"), "patch")
    return datasets.withColumn("kind", kind.otherwise("nuclei"))


def dataset_slides(slides: DataFrame, links: DataFrame, datasets: DataFrame) -> DataFrame:
    """Slides of each dataset with the dataset name, ordered by slide name."""
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    return (
        slides.withColumnRenamed("id", "slide_id").join(links, "slide_id").join(named, "dataset_id")
        .orderBy("name", "dataset")
    )


def sets_for_dataset(sets: DataFrame, datasets: DataFrame) -> DataFrame:
    """Training or test sets with the name of their dataset."""
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    return sets.join(named, "dataset_id")


def trainset_classes(classes: DataFrame, training_sets: DataFrame) -> DataFrame:
    named = training_sets.select(F.col("id").alias("training_set_id"), F.col("name").alias("training_set"))
    return classes.join(named, "training_set_id").orderBy("training_set", "label")


def trainset_class_counts(training_objs: DataFrame, training_sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects per training set and class, joined by training set id; counted before the joins."""
    counts = training_objs.groupBy("training_set_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    sets = training_sets.select(F.col("id").alias("training_set_id"), F.col("name").alias("training_set"))
    kinds = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class"))
    return counts.join(sets, "training_set_id").join(kinds, "class_id").select("training_set", "class", "n")


def enrich_samples(samples: DataFrame, slides: DataFrame) -> DataFrame:
    """Slide size, path and scale for each sample; samples on unknown slides stay."""
    info = slides.select(
        F.col("name").alias("slide"), F.col("x_size").alias("max_x"), F.col("y_size").alias("max_y"),
        F.col("pyramid_path").alias("path"), "scale",
    )
    return samples.join(info, "slide", "left")


def new_slides(offered: DataFrame, known: DataFrame) -> DataFrame:
    return offered.join(known.select("name"), "name", "left_anti")


def name_conflicts(offered: DataFrame, known: DataFrame) -> DataFrame:
    return offered.join(known.select("name"), "name", "left_semi")


def link_dataset_slides(slide_names: DataFrame, slides: DataFrame, dataset_id: Column | int) -> DataFrame:
    """Link rows (slide_id, dataset_id) of the listed slides that exist."""
    ident = dataset_id if isinstance(dataset_id, Column) else F.lit(dataset_id)
    return slides.join(slide_names.select("name").distinct(), "name", "left_semi").select(
        F.col("id").alias("slide_id"), ident.alias("dataset_id")
    )


def next_ids(new_rows: DataFrame, existing: DataFrame, order: str, column: str = "id") -> DataFrame:
    """Consecutive ids after the largest one in use. For catalog rows, which are few."""
    top = existing.agg(F.coalesce(F.max(column), F.lit(0))).scalar()
    numbered = new_rows.withColumn("_rn", F.row_number().over(Window.orderBy(order)))
    return numbered.withColumn(column, F.col("_rn") + top).drop("_rn")


def cascade_delete(dataset_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of each table after deleting datasets: their links, training sets with
    classes and objects, and test sets go too. ``dataset_ids`` has a column ``id``."""
    gone = dataset_ids.select(F.col("id").alias("dataset_id"))
    gone_sets = tables["training_sets"].join(gone, "dataset_id", "left_semi").select(
        F.col("id").alias("training_set_id")
    )
    left = dict(tables)
    left["datasets"] = tables["datasets"].join(dataset_ids.select("id"), "id", "left_anti")
    for name in ("dataset_slides", "training_sets", "test_sets"):
        if name in tables:
            left[name] = tables[name].join(gone, "dataset_id", "left_anti")
    for name in ("classes", "training_objs"):
        if name in tables:
            left[name] = tables[name].join(gone_sets, "training_set_id", "left_anti")
    return left


def replace_by_slide(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of slides that are imported again are replaced by the new ones."""
    kept = existing.join(incoming.select("slide").distinct(), "slide", "left_anti")
    return kept.unionByName(incoming)


def upsert_training_objs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New objects are added; known ones take the incoming class and keep their iteration."""
    keys = ["training_set_id", "cell_id"]
    new = incoming.select(*keys, F.col("iteration").alias("_it"), F.col("class_id").alias("_class"))
    return existing.join(new, keys, "full_outer").select(
        *keys,
        F.coalesce("iteration", "_it").alias("iteration"),
        F.coalesce("_class", "class_id").alias("class_id"),
    )


def thumbnail_window(samples: DataFrame, region: bool = False) -> DataFrame:
    """Crop window of each sample relative to its slide (needs max_x, max_y, scale and, for
    regions, superpixel_size). Null on a slide without extent."""
    if region:
        size = F.col("superpixel_size")
        offset = F.when(size == 8, REGION_CROPS[8][0]).when(size == 16, REGION_CROPS[16][0]).otherwise(REGION_CROPS[None][0])
        extent = F.when(size == 8, REGION_CROPS[8][1]).when(size == 16, REGION_CROPS[16][1]).otherwise(REGION_CROPS[None][1])
    else:
        offset, extent = F.lit(NUCLEUS_CROP[0]), F.lit(NUCLEUS_CROP[1])
    return samples.withColumns({
        "left": F.try_divide(F.col("x") - offset * F.col("scale"), F.col("max_x")),
        "top": F.try_divide(F.col("y") - offset * F.col("scale"), F.col("max_y")),
        "width": F.try_divide(extent * F.col("scale"), F.col("max_x")),
        "height": F.try_divide(extent * F.col("scale"), F.col("max_y")),
    })


def session_defaults(labeled: DataFrame) -> DataFrame:
    """A missing click is the centroid; a missing patch size is 28."""
    changes = {"click_x": F.coalesce("click_x", "x"), "click_y": F.coalesce("click_y", "y")}
    if "patch_size" in labeled.columns:
        changes["patch_size"] = F.coalesce("patch_size", F.lit(DEFAULT_PATCH_SIZE))
    return labeled.withColumns(changes)


def label_names(df: DataFrame, negative: str = DEFAULT_CLASS_NAMES[0], positive: str = DEFAULT_CLASS_NAMES[1]) -> DataFrame:
    label = F.col("label")
    return df.withColumn(
        "class_name", F.when(label == 1, positive).when(label == -1, negative).otherwise("Ignore")
    )


def review_order(slides: DataFrame, column: str = "slide") -> DataFrame:
    """Slides without regard to case."""
    return slides.orderBy(F.upper(column), column)


def order_table(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(column, ascending=ascending)
