from retentio.operators import clusters


def test_fits_get_points_that_are_not_cached_as_a_table(spark, monkeypatch):
    """A fit over a cached table decodes it again in every iteration; left alone, it keeps its own vectors."""
    seen, plain = [], clusters.fit_kmeans

    def recorded(points, *args, **kwargs):
        level = points.storageLevel
        seen.append(level.useMemory or level.useDisk)
        return plain(points, *args, **kwargs)

    monkeypatch.setattr(clusters, "fit_kmeans", recorded)
    rows = [(i, float(i % 3), float(i % 2), 1.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "client_id long, recency double, frequency double, monetary double")
    fitted = clusters.fit_clusters(df, k=2, starts=2)
    assert seen == [False] and len(fitted.centres) == 2


def test_choice_of_k_tries_every_k_with_all_starts(spark, monkeypatch):
    """The registered query tried k from 2 to 4 with one start each."""
    import __spark_entry__ as entry
    from checks import stages

    seen, plain = [], clusters.fit_kmeans

    def recorded(points, k, seed=42, starts=10, *args, **kwargs):
        seen.append((k, starts))
        return plain(points, k, seed, 1, max_iter=2)

    monkeypatch.setattr(clusters, "fit_kmeans", recorded)
    rows = [(i, float(i % 7) + 0.01 * i, float(i % 5), 1.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "client_id long, recency double, frequency double, monetary double")
    monkeypatch.setattr(stages, "features", lambda *_: df)
    out = entry.queries()["kmeans_choice_of_k"](spark, "").collect()
    assert sorted(seen) == [(k, 10) for k in range(2, 11)]
    assert [r["k"] for r in out] == list(range(2, 11))
