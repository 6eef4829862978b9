from chirpline import session


def test_runs_lie_in_the_shared_folder_and_can_be_removed(spark):
    path = session.run_dir(spark, "probe")
    assert path.startswith(session.shared_dir(spark) + "/chirpline/probe-") and path != session.run_dir(spark, "probe")
    spark.range(3).write.parquet(path)
    fs, target = session.file_system(spark, path)
    assert fs.exists(target) and session.remove_runs(spark) and not fs.exists(target)
