"""labelflow: a Spark-native pipeline for labelled image/text and video/text content.

Every operator takes a DataFrame and returns a DataFrame. The only eager jobs inside operators
are lineage cuts into ``spark.checkpoint.dir`` (seeded-shuffle offsets, model fits) and the
early-terminating frame choice's check for undecided videos.
Subpackages:

- ``sources``   scans and sinks (item CSVs, exemplar descriptions, frame images, predictions)
- ``functions`` column expressions (prompts, chat messages, token rows, pixels)
- ``operators`` relational operators (splits, frame choice, exemplars, ordering, batches,
  votes, metrics, regimes, naive Bayes as aggregations, prediction)
- ``plans``     the registered queries over the shared test tables
- ``streaming`` stream helpers for the stateless operators
"""

__version__ = "0.1.0"
