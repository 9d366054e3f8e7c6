import pytest


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark):
    """Write rows as a table of a new folder: folder(documents=frame) -> path."""
    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)
    return write
