"""Citation verification over large document collections, written as Spark DataFrame jobs."""
