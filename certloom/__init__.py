"""certloom: Spark jobs that turn messy inspection records into clean tables."""
