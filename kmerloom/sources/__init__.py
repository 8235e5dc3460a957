"""Sources and sinks: FASTA and FASTQ (plain or gzip), sketch files and Parquet stores, CSV tables, mixed inputs."""
