"""Where the given tables lie."""

SF = "/root/testdata/sf0.001"
