"""skein: sensor-cycle analytics on Spark DataFrames."""
