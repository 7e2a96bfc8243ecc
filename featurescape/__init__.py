"""featurescape: exploring multivariate tables with Spark.

Modules
-------
session               session defaults, checkpoint folder, ``materialize``
sources.tables        pandas-typed CSV / Parquet input, ``ID`` column
sources.interchange   snapshot files (features, meta, schema, positions, catalogue)
sources.files         dataset discovery, thumbnails, image archives
operators.ids         file-order ids, exact global positions
operators.encode      label / min-max encoding, standardisation
operators.profile     min, max, exact median, variance, 50-bin histograms, meta
operators.filters     range / text / id filters, AND/OR composition, passive flags
operators.positions   geographic, pair and PCA positions, view scaling
operators.spatial     radius neighbours, nearest items, view predicates
operators.cluster     greedy ball clustering, grid clustering
operators.embed       exact kNN graph, neighbour embeddings
operators.items       schema document, item records, id joins
operators.catalog     snapshot catalogue
functions.*           Column functions: numbers, colours, view maths, glyph geometry
plans.*               the exploration plan, snapshot preparation, registered queries
streaming.live        encoder and filters on a stream

Typical use::

    from featurescape.session import get_session
    from featurescape.sources.tables import read_table
    from featurescape.operators import encode, filters, profile

    spark = get_session()
    raw = read_table(spark, "cars.csv")                 # ID + typed columns
    items, model = encode.encode_features(raw)          # normalised features
    meta = profile.build_meta(raw)                      # per-column statistics
    view = filters.mark_passive(items, [filters.FeatureFilter("hp", 0.2, 0.8)])
"""

__version__ = "0.1.0"
