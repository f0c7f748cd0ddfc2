"""Out-of-core runs: edges stream from storage in slices, only vertex state is worked on."""
