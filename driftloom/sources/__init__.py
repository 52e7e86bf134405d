"""driftloom.sources"""
