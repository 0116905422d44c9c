"""The SQL functions a workload uses: a catalogue of examples, and a classifier."""
