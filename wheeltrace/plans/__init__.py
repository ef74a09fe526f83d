"""Ready-made queries over the test tables and the end-to-end flows built from the operators."""
